"""Polygons, masks, fill and edges against plain loops."""

import math
import random
import re

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from facetwatch.functions import patches, raster, regions
from facetwatch.operators import lineage


def pixel_rows(spark, images):
    rows = [(k, y, x, int(v)) for k, img in images.items() for y, line in enumerate(img) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "patch long, y int, x int, v int").repartition(5)


def images(seed=1, levels=(0, 0, 0, 90, 200, 255)):
    rng = random.Random(seed)
    out = {k: [[rng.choice(levels) for _ in range(rng.choice([w]))] for _ in range(h)] for k, (h, w) in enumerate([(6, 9), (9, 6), (1, 7), (7, 1), (1, 1), (12, 12), (8, 8), (5, 5)])}
    out[20] = [[0] * 6 for _ in range(5)]
    out[21] = [[200] * 6 for _ in range(5)]
    ring = [[200 if 1 <= max(abs(y - 4), abs(x - 4)) <= 3 else 0 for x in range(9)] for y in range(9)]
    ring[4][4] = 180  # an island in the hole of a ring
    out[22] = [[200 if max(abs(y - 4), abs(x - 4)) == 3 else (180 if (y, x) == (4, 4) else 0) for x in range(9)] for y in range(9)]
    out[23] = ring
    out[24] = [[200, 0, 200], [0, 0, 0], [200, 0, 200]]  # equal parts: the first wins
    out[2**31] = [[rng.choice((0, 200)) for _ in range(20)] for _ in range(20)]
    return out


def parts(cells):
    out, left = [], set(cells)
    while left:
        stack, part = [min(left)], set()
        while stack:
            c = stack.pop()
            if c in left:
                left.remove(c)
                part.add(c)
                stack += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
        out.append(part)
    return out


def plain_mask(img, threshold):
    h, w = len(img), len(img[0])
    cells = {(y, x) for y in range(h) for x in range(w)}
    dark = {c for c in cells if img[c[0]][c[1]] <= threshold}
    outside = set().union(*(p for p in parts(dark) if any(y in (0, h - 1) or x in (0, w - 1) for y, x in p)))
    found = parts(cells - outside)
    return max(found, key=lambda p: (len(p), [-v for v in min(p)])) if found else set()


def got(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.patch, set()).add(tuple(r[c] for c in columns or ("y", "x")))
    return out


def test_mask_equals_flood_fill(spark):
    imgs = images()
    assert got(regions.patch_mask(pixel_rows(spark, imgs), 50)) == {k: m for k, img in imgs.items() if (m := plain_mask(img, 50))}


def test_nearest_pixel_equals_search(spark):
    imgs = images(3)
    mask = {k: plain_mask(img, 100) for k, img in imgs.items()}
    px = pixel_rows(spark, imgs)
    want = {}
    for k, m in mask.items():
        if m:
            for y, line in enumerate(imgs[k]):
                for x in range(len(line)):
                    fy, fx = min(m, key=lambda c: ((c[0] - y) ** 2 + (c[1] - x) ** 2, c))
                    want.setdefault(k, set()).add((y, x, fy, fx, imgs[k][fy][fx]))
    assert got(regions.nearest_inside(px, regions.patch_mask(px, 100)), "y", "x", "from_y", "from_x", "v") == want


def plain_canny(img, low=50, high=150):
    h, w = len(img), len(img[0])
    at = lambda y, x: img[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    gx = {(y, x): sum((2 - abs(d)) * (at(y + d, x + 1) - at(y + d, x - 1)) for d in (-1, 0, 1)) for y in range(h) for x in range(w)}
    gy = {(y, x): sum((2 - abs(d)) * (at(y + 1, x + d) - at(y - 1, x + d)) for d in (-1, 0, 1)) for y in range(h) for x in range(w)}
    m = {c: abs(gx[c]) + abs(gy[c]) for c in gx}
    t, thin = math.tan(math.pi / 8), set()
    for (y, x), v in m.items():
        n = lambda dy, dx: m.get((y + dy, x + dx), 0)  # noqa: B023, E731
        ax, ay = abs(gx[y, x]), abs(gy[y, x])
        if ay < t * ax:
            top = v > n(0, -1) and v >= n(0, 1)
        elif ay > ax / t:
            top = v > n(-1, 0) and v >= n(1, 0)
        else:
            s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
            top = v > n(-1, -s) and v > n(1, s)
        if top and v > low:
            thin.add((y, x))
    edge, stack = set(), [c for c in thin if m[c] > high]
    while stack:
        c = stack.pop()
        if c in thin and c not in edge:
            edge.add(c)
            stack += [(c[0] + dy, c[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return edge


def test_edges_equal_plain_loops(spark):
    imgs = images(5, (0, 20, 30, 40, 60, 90, 120))
    found = got(regions.canny(regions.gradients(pixel_rows(spark, imgs))))
    want = {k: e for k, img in imgs.items() if (e := plain_canny(img))}
    assert found == want and sum(map(len, want.values())) > 50
    share = {r.patch: r.edge_density for r in regions.edge_density(pixel_rows(spark, imgs)).collect()}
    assert share == {k: len(want.get(k, ())) / (len(img) * len(img[0])) for k, img in imgs.items()}


def test_masked_edges_of_flat_and_small_masks(spark):
    imgs = images(7)
    px = pixel_rows(spark, imgs)
    rows = {r.patch: r for r in regions.masked_edges(px, regions.patch_mask(px, 50)).collect()}
    flat = rows[21]  # one level: no slope, no edge, whatever lies outside
    assert (flat.core_pixels, flat.sobel_mean, flat.laplacian_std, flat.edge_density) == (12, 0.0, 0.0, 0.0)
    assert 20 not in rows and rows[4 if 4 in rows else 24].sobel_mean is None and rows[24].core_pixels == 0
    assert regions.masked_edges(px.limit(0), regions.patch_mask(px.limit(0), 50)).collect() == []


def plain_polygon(points):
    n, out = len(points), set()
    sides = [(points[i], points[(i + 1) % n]) for i in range(n)]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    for y in range(min(ys), max(ys) + 1):
        for x in range(min(xs), max(xs) + 1):
            left = 0
            for (ax, ay), (bx, by) in sides:
                if (ay <= y < by or by <= y < ay) and (x - ax) * (by - ay) * (1 if by > ay else -1) > (y - ay) * (bx - ax) * (1 if by > ay else -1):
                    left += 1
            if left % 2:
                out.add((y, x))
    for a, b in sides:
        (ax, ay), (bx, by) = min(a, b), max(a, b)
        far = max(bx - ax, abs(by - ay))
        for k in range(far + 1):
            m = math.ceil(k * min(bx - ax, abs(by - ay)) / max(far, 1) - 0.5)
            s = (by > ay) - (by < ay)
            out.add((ay + s * m, ax + k) if bx - ax >= abs(by - ay) else (ay + s * k, ax + m))
    return out


SHAPES = {
    1: [(0, 0), (9, 3), (4, 11)], 2: [(2, 2), (12, 2), (12, 9), (7, 4), (2, 9)], 3: [(0, 0), (10, 10), (10, 0), (0, 10)], 4: [(5, 5)], 5: [(1, 1), (8, 4)], 6: [(-6, -4), (3, -2), (2, 6)],
    7: [(0, 0), (6, 0), (6, 6), (0, 6)], 8: [(3, 0), (6, 9), (0, 3), (6, 3), (0, 9)], 9: [(4, 4), (4, 4), (4, 4)],
}


def shape_table(spark):
    rng = random.Random(2)
    more = {100 + k: [(rng.randrange(-9, 20), rng.randrange(-9, 20)) for _ in range(rng.randrange(1, 9))] for k in range(60)}
    shapes = SHAPES | more
    rows = [(k, [{"x": x, "y": y} for x, y in p]) for k, p in shapes.items()] + [(0, [])]
    return shapes, spark.createDataFrame(rows, "key long, points array<struct<x: int, y: int>>")


def test_polygons_equal_the_even_odd_test(spark):
    shapes, table = shape_table(spark)
    rows = raster.polygon_pixels(table).collect()
    out = {}
    for r in rows:
        out.setdefault(r.key, set()).add((r.y, r.x))
    assert out == {k: plain_polygon(p) for k, p in shapes.items()} and len(rows) == sum(map(len, out.values()))
    clipped = raster.polygon_pixels(table, 8, 10).collect()
    assert {(r.key, r.y, r.x) for r in clipped} == {(k, y, x) for k, c in out.items() for y, x in c if 0 <= y < 8 and 0 <= x < 10}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_facets_are_cut_from_frames(spark, limit):
    shapes, table = shape_table(spark)
    frames = spark.range(3).select(F.col("id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("y")).select("frame", "y", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("x"))
    frames = frames.withColumn("v", F.col("frame") * 1000 + F.col("y") * 15 + F.col("x"))
    rows = {(r.frame, r.key, r.y, r.x, r.v) for r in raster.cut_facets(frames, table, broadcast_rows=limit).collect()}
    want = set()
    for k, p in shapes.items():
        x0, y0 = min(x for x, _ in p), min(y for _, y in p)
        want |= {(f, k, y - y0, x - x0, f * 1000 + y * 15 + x) for f in range(3) for y, x in plain_polygon(p) if 0 <= y < 12 and 0 <= x < 15}
    assert rows == want


def test_families_share_one_exchange_of_the_pixels(spark):
    px = patches.pixel_table(spark.read.parquet(f"{DATA}/embeddings.parquet"), "vec_id", "embedding", 8)
    out = patches.family_table(px, ["glcm", "lbp", "edges"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 4


def test_parts_grow_with_the_pixels(spark, monkeypatch):
    """Tasks take a bounded number of pixels, also where adaptive execution would join their parts up."""
    monkeypatch.setattr(patches, "PART_PIXELS", 1_000)
    px = patches.pixel_table(spark.read.parquet(f"{DATA}/embeddings.parquet"), "vec_id", "embedding", 8)
    assert patches.dealt(px).rdd.getNumPartitions() == 32
    table = patches.family_table(px, ["texture"])
    assert table.count() == 500
    assert "hashpartitioning(patch#" in (plan := table._jdf.queryExecution().executedPlan().toString()) and ", 32), REPARTITION_BY_NUM" in plan


def test_bands_hang_together(spark, monkeypatch):
    """Parts that reach over bands are those of plain loops; within one band there are no rounds of components."""
    imgs = images(11)
    want = {k: m for k, img in imgs.items() if (m := plain_mask(img, 50))}
    calls, whole = [], lineage.components
    monkeypatch.setattr(lineage, "components", lambda edges: calls.append(1) or whole(edges))
    assert got(regions.patch_mask(pixel_rows(spark, imgs), 50)) == want and not calls
    monkeypatch.setattr(regions, "BAND", 1)
    assert got(regions.patch_mask(pixel_rows(spark, imgs), 50)) == want and calls


def holes(seed=13):
    """Places with some missing, and some without a level."""
    rng = random.Random(seed)
    sizes = {1: (9, 7), 2: (1, 6), 3: (6, 1), 4: (1, 1), 5: (12, 12)}
    return {(k, y, x): rng.choice((None, *range(1, 256))) for k, (h, w) in sizes.items() for y in range(h) for x in range(w) if k == 4 or rng.random() < 0.9}


def level_rows(spark, levels):
    return spark.createDataFrame([(*c, v) for c, v in levels.items()], "patch long, y int, x int, v int").repartition(3)


@pytest.mark.parametrize("kernels", [{"gx": patches.SOBEL_X, "gy": patches.SOBEL_Y}, {"lap": patches.LAPLACE}, {"far": {(0, -3): 1.0, (-2, 0): 2.0, (0, 2): -1.0}}, {"skew": {(1, 2): 1.0, (-1, 1): 3.0}}])
def test_weighted_neighbours_equal_plain_loops(spark, kernels):
    levels = holes()
    offsets = {o for k in kernels.values() for o in k} | {(0, 0)}
    want = {}
    for p, y, x in levels:
        near = {o: (p, y + o[0], x + o[1]) for o in offsets}
        if all(c in levels for c in near.values()):
            some = any(levels[c] is not None for c in near.values())
            want[p, y, x] = [sum(w * (levels[near[o]] or 0) for o, w in k.items()) if some else None for k in kernels.values()]
    rows = patches.convolve(level_rows(spark, levels), kernels).collect()
    assert {(r.patch, r.y, r.x): [r[n] for n in kernels] for r in rows} == want and len(rows) == len(want) > 5


@pytest.mark.parametrize("mirror", [False, True])
def test_borders_equal_padded_patches(spark, mirror):
    """What counts beyond the border is what ``padded`` puts there, also beside missing pixels."""
    px = level_rows(spark, holes(17))
    kernels = {"gx": patches.SOBEL_X, "gy": patches.SOBEL_Y, "lap": patches.LAPLACE}
    want = patches.convolve(regions.padded(px, mirror=mirror), kernels).collect()
    assert sorted(map(tuple, regions.gradients(px, mirror).collect()), key=repr) == sorted(map(tuple, want), key=repr) and len(want) > 60


@pytest.mark.parametrize("distance", [1, 2])
def test_pairs_of_levels_equal_plain_loops(spark, distance):
    levels, want = holes(19), {}
    for (p, y, x), v in levels.items():
        for a, (dy, dx) in enumerate(patches.ANGLES):
            other = (p, y + dy * distance, x + dx * distance)
            if other in levels:
                pair = (p, a, *(None if c is None else c * 8 // 256 for c in (v, levels[other])))
                want[pair] = want.get(pair, 0) + 1
    rows = patches.glcm(level_rows(spark, levels), 8, distance, symmetric=False).collect()
    assert {(r.patch, r.angle, r.i, r.j): r.n for r in rows} == want and len(rows) == len(want)


def test_families_need_no_exchange_besides_the_dealing(spark):
    """Neighbours are read where the patch lies; pixels are neither multiplied nor dealt out by place."""
    px = patches.pixel_table(spark.read.parquet(f"{DATA}/embeddings.parquet"), "vec_id", "embedding", 8)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = patches.family_table(px, ["glcm", "lbp", "edges"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    keys = set(re.findall(r"hashpartitioning\((.*?), \d+\)", plan))
    assert keys and all(re.fullmatch(r"patch#\d+L", k) for k in keys)
