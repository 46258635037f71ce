"""Registered queries of polygons, masks, edges, spectra, resampling and frame measures, each with its SQL.

Polygons and patches are made from the embeddings, so that work grows with them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from facetwatch.functions import colours as colour
from facetwatch.functions import frames, patches, raster, regions, spectra
from facetwatch.functions.patches import LAPLACE, SOBEL_X, SOBEL_Y
from facetwatch.operators import pluggable
from facetwatch.operators.lineage import cut, scratch
from facetwatch.plans.inputs import COLOURS, PIXELS, colours, pixels, read
from facetwatch.plans.queries import _FIVE, _GRAD, _moments, _r, _sql_codes, _sql_glcm, _sql_near, query, rnd
from facetwatch.sources import images, store

# Polygons.

_HEX = [(6, 0), (3, 5), (-3, 5), (-6, 0), (-3, -5), (3, -5)]
_QUAD = [(0, 0), (3, 1), (2, 4), (-1, 2)]


def _shapes(spark, sf_dir):
    """A six-cornered polygon from the first twelve elements of each vector."""
    at = lambda k, base: (F.floor(F.col("embedding")[k].cast("double") * 8) + base).cast("int")
    points = F.array(*(F.struct(at(2 * k, x).alias("x"), at(2 * k + 1, y).alias("y")) for k, (x, y) in enumerate(_HEX)))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), points.alias("points"))


def _facets(spark, sf_dir):
    """Facets of an 8 x 8 frame, one for each nation; some reach over its border."""
    n = F.col("n_nationkey")
    points = F.array(*(F.struct((n % 5 + x).cast("int").alias("x"), (F.floor(n / 5) + y).cast("int").alias("y")) for x, y in _QUAD))
    return read(spark, sf_dir, "nation").select(n.alias("key"), points.alias("points"))


_SHAPES = "cn AS (" + " UNION ALL ".join(f"SELECT vec_id AS key, {k} AS k, (floor(embedding[{2 * k + 1}]::DOUBLE * 8) + {x})::INTEGER AS x, (floor(embedding[{2 * k + 2}]::DOUBLE * 8) + {y})::INTEGER AS y FROM embeddings" for k, (x, y) in enumerate(_HEX)) + ")"
_FACETS = "cn AS (" + " UNION ALL ".join(f"SELECT n_nationkey AS key, {k} AS k, (n_nationkey % 5 + {x})::INTEGER AS x, (n_nationkey // 5 + {y})::INTEGER AS y FROM nation" for k, (x, y) in enumerate(_QUAD)) + ")"


def _sql_raster(corners: int) -> str:
    """CTE ``pp``: pixels of the polygons of ``cn``, tested one by one: inside by the number of edges to the left, or on an edge's steps."""
    return f"""eg AS (SELECT a.key, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM cn a JOIN cn b ON a.key = b.key AND b.k = (a.k + 1) % {corners}),
    bx AS (SELECT key, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM cn GROUP BY key), rw AS (SELECT key, xl, xh, unnest(range(yl, yh + 1)) AS y FROM bx), al AS (SELECT key, y, unnest(range(xl, xh + 1)) AS x FROM rw),
    up AS (SELECT key, CASE WHEN y0 < y1 THEN x0 ELSE x1 END AS xa, least(y0, y1) AS ya, CASE WHEN y0 < y1 THEN x1 ELSE x0 END AS xb, greatest(y0, y1) AS yb FROM eg WHERE y0 <> y1),
    ins AS (SELECT al.key, al.y, al.x FROM al JOIN up ON al.key = up.key AND al.y >= ya AND al.y < yb AND xa * (yb - ya) + (al.y - ya) * (xb - xa) < al.x * (yb - ya) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
    ori AS (SELECT key, CASE WHEN s THEN x1 ELSE x0 END AS xa, CASE WHEN s THEN y1 ELSE y0 END AS ya, CASE WHEN s THEN x0 ELSE x1 END AS xb, CASE WHEN s THEN y0 ELSE y1 END AS yb FROM (SELECT *, x0 > x1 AS s FROM eg)),
    stp AS (SELECT *, greatest(xb - xa, abs(yb - ya)) AS far, least(xb - xa, abs(yb - ya)) AS near, unnest(range(greatest(xb - xa, abs(yb - ya)) + 1)) AS k FROM ori),
    sd AS (SELECT *, ceil(k * near / greatest(far, 1)::DOUBLE - 0.5)::BIGINT AS m FROM stp), bd AS (SELECT key, ya + sign(yb - ya) * CASE WHEN xb - xa >= abs(yb - ya) THEN m ELSE k END AS y, xa + CASE WHEN xb - xa >= abs(yb - ya) THEN k ELSE m END AS x FROM sd),
    pp AS (SELECT key, y::BIGINT AS y, x::BIGINT AS x FROM ins UNION SELECT key, y::BIGINT, x::BIGINT FROM bd)"""


@query(f"WITH {_SHAPES}, {_sql_raster(6)} SELECT key, y, x FROM pp")
def polygon_pixels(spark, sf_dir):
    return raster.polygon_pixels(_shapes(spark, sf_dir))


@query(f"WITH {PIXELS}, {_FACETS}, {_sql_raster(4)} SELECT px.patch AS frame, pp.key, pp.y - bx.yl AS y, pp.x - bx.xl AS x, px.v FROM pp JOIN bx ON bx.key = pp.key JOIN px ON px.y = pp.y AND px.x = pp.x")
def facet_crops(spark, sf_dir):
    return raster.cut_facets(pixels(spark, sf_dir).withColumnRenamed("patch", "frame"), _facets(spark, sf_dir))


# Masks, fill and edges.


def _sql_points(points: int, radius: int) -> str:
    """Columns ``n0 ...``: neighbours on a circle minus the centre, from the square around a place."""
    return ", ".join(" + ".join(f"({w})::DOUBLE * a_{dy + radius}_{dx + radius}" for (dy, dx), w in sorted(k.items())) + f" AS {n}" for n, k in patches.lbp_kernels(points, float(radius)).items())


def _sql_code(points: int) -> str:
    bits = [f"(n{p} >= -1e-9)::INTEGER" for p in range(points)]
    return f"CASE WHEN {' + '.join(f'abs({bits[p]} - {bits[p - 1]})' for p in range(points))} <= 2 THEN {' + '.join(bits)} ELSE {points + 1} END"


MASK_ABOVE = 110
_MASK = f"""bg AS (SELECT patch, y, x FROM px WHERE v <= {MASK_ABOVE}), ot AS (SELECT patch, y, x FROM bg WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT b.patch, b.y, b.x FROM ot JOIN bg b ON b.patch = ot.patch AND abs(b.y - ot.y) + abs(b.x - ot.x) = 1),
    fl AS (SELECT px.patch, px.y, px.x, 8 * px.y + px.x AS k FROM px ANTI JOIN ot ON px.patch = ot.patch AND px.y = ot.y AND px.x = ot.x),
    lb AS (SELECT patch, y, x, k, k AS root FROM fl UNION SELECT f.patch, f.y, f.x, f.k, lb.root FROM lb JOIN fl f ON f.patch = lb.patch AND abs(f.y - lb.y) + abs(f.x - lb.x) = 1 AND f.k > lb.root),
    rt AS (SELECT patch, y, x, min(root) AS root FROM lb GROUP BY 1, 2, 3), sz AS (SELECT patch, root, count(*) AS n FROM rt GROUP BY 1, 2), tp AS (SELECT patch, arg_min(root, -n * 100 + root) AS root FROM sz GROUP BY patch), mk AS (SELECT rt.patch, rt.y, rt.x FROM rt JOIN tp ON rt.patch = tp.patch AND rt.root = tp.root)"""
_FILL = """fd AS (SELECT px.patch, px.y, px.x, arg_min(mk.y * 8 + mk.x, ((mk.y - px.y) ** 2 + (mk.x - px.x) ** 2) * 64 + mk.y * 8 + mk.x) AS k FROM px JOIN mk ON mk.patch = px.patch GROUP BY 1, 2, 3),
    ff AS (SELECT fd.patch, fd.y, fd.x, k // 8 AS from_y, k % 8 AS from_x, px.v FROM fd JOIN px ON px.patch = fd.patch AND px.y = k // 8 AND px.x = k % 8)"""


def _sql_slopes(source: str, tag: str) -> str:
    """CTE ``tag``: gradients of all places of ``source``, with the border's pixels repeated beyond it."""
    at = ", ".join(f"({dy}, {dx}, {SOBEL_X.get((dy, dx), 0):g}, {SOBEL_Y.get((dy, dx), 0):g}, {LAPLACE.get((dy, dx), 0):g})" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return f"""{tag} AS (SELECT c.patch, c.y, c.x, sum(n.v * sx)::DOUBLE AS gx, sum(n.v * sy)::DOUBLE AS gy, sum(n.v * lp)::DOUBLE AS lap FROM {source} c CROSS JOIN (VALUES {at}) o(dy, dx, sx, sy, lp)
    JOIN {source} n ON n.patch = c.patch AND n.y = least(7, greatest(0, c.y + dy)) AND n.x = least(7, greatest(0, c.x + dx)) GROUP BY 1, 2, 3)"""


def _sql_canny(slopes: str, tag: str) -> str:
    """CTE ``tag``: edge pixels by thinning and by spreading from strong ones."""
    near = ", ".join(f"max(CASE WHEN n.y = c.y + ({dy}) AND n.x = c.x + ({dx}) THEN n.m ELSE 0 END) AS {name}" for name, (dy, dx) in regions.AROUND.items())
    return f"""m{tag} AS (SELECT *, abs(gx) + abs(gy) AS m FROM {slopes}), n{tag} AS (SELECT c.patch, c.y, c.x, c.gx, c.gy, c.m, {near} FROM m{tag} c JOIN m{tag} n ON n.patch = c.patch AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 GROUP BY 1, 2, 3, 4, 5, 6),
    w{tag} AS (SELECT patch, y, x, m FROM n{tag} WHERE m > {regions.LOW} AND CASE WHEN abs(gy) < abs(gx) * {regions.TAN_22 / 32768} THEN m > w AND m >= e WHEN abs(gy) > abs(gx) * {regions.TAN_22 / 32768 + 2} THEN m > n AND m >= s WHEN (gx < 0) <> (gy < 0) THEN m > ne AND m > sw ELSE m > nw AND m > se END),
    {tag} AS (SELECT patch, y, x FROM w{tag} WHERE m > {regions.HIGH} UNION SELECT w.patch, w.y, w.x FROM {tag} t JOIN w{tag} w ON w.patch = t.patch AND abs(w.y - t.y) <= 1 AND abs(w.x - t.x) <= 1)"""


@query(f"WITH RECURSIVE {PIXELS}, {_MASK} SELECT patch, y, x FROM mk")
def patch_mask(spark, sf_dir):
    return regions.patch_mask(pixels(spark, sf_dir), MASK_ABOVE)


@query(f"WITH RECURSIVE {PIXELS}, {_MASK}, {_FILL} SELECT patch, y, x, from_y::BIGINT AS from_y, from_x::BIGINT AS from_x, v FROM ff")
def patch_fill(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return regions.nearest_inside(px, regions.patch_mask(px, MASK_ABOVE))


@query(f"WITH RECURSIVE {PIXELS}, {_sql_slopes('px', 'sl')}, {_sql_canny('sl', 'ce')} SELECT patch, y, x FROM ce")
def patch_canny(spark, sf_dir):
    return regions.canny(regions.gradients(pixels(spark, sf_dir)))


@query(f"""WITH RECURSIVE {PIXELS}, {_MASK}, {_FILL}, {_sql_slopes('ff', 'sl')}, {_sql_canny('sl', 'ce')},
    co AS (SELECT a.patch, a.y, a.x FROM mk a JOIN mk b ON b.patch = a.patch AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 9),
    ag AS (SELECT co.patch, count(*) AS n, avg(sqrt(gx * gx + gy * gy)) AS sm, avg(abs(lap)) AS lm, stddev_pop(abs(lap)) AS ls, count(ce.patch) / count(*) AS ed FROM co JOIN sl USING (patch, y, x) LEFT JOIN ce USING (patch, y, x) GROUP BY co.patch)
    SELECT t.patch, coalesce(n, 0) AS core_pixels, {_r(*(f"{c}=CASE WHEN n >= 10 THEN {e} END" for c, e in (("sobel_mean", "sm"), ("laplacian_mean", "lm"), ("laplacian_std", "ls"), ("edge_density", "ed"))))} FROM tp t LEFT JOIN ag USING (patch)""")
def patch_masked_edges(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return rnd(regions.masked_edges(px, regions.patch_mask(px, MASK_ABOVE)))


@query(f"""WITH RECURSIVE {PIXELS}, {_sql_near(1)}, {_sql_codes(8, 1)}, {_GRAD}, {_sql_glcm(256, 1, False, 4, '')}, a AS (SELECT patch, {', '.join(f'avg({c}) AS {c}' for c in _FIVE)} FROM cc GROUP BY patch),
    b AS (SELECT patch, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS lbp_entropy, max(n) / sum(n) AS lbp_uniformity, sum(CASE WHEN code = 9 THEN n ELSE 0 END) / sum(n) AS lbp_nonuniform FROM hc1 GROUP BY patch),
    c AS (SELECT patch, avg(sqrt(gx * gx + gy * gy)) AS sobel_mean, avg(abs(lap)) AS laplacian_mean, stddev_pop(abs(lap)) AS laplacian_std FROM gr GROUP BY patch),
    {_sql_slopes('px', 'sl')}, {_sql_canny('sl', 'ce')}, d AS (SELECT px.patch, count(ce.patch) / count(*) AS edge_density FROM px LEFT JOIN ce USING (patch, y, x) GROUP BY px.patch)
    SELECT patch, {_r(*_FIVE, 'lbp_entropy', 'lbp_uniformity', 'lbp_nonuniform', 'sobel_mean', 'laplacian_mean', 'laplacian_std', 'edge_density')} FROM a JOIN b USING (patch) JOIN c USING (patch) JOIN d USING (patch)""")
def patch_standard(spark, sf_dir):
    """The registry's standard families in one table, a row per patch."""
    return rnd(patches.family_table(pixels(spark, sf_dir)))


# Spectra, resampling, block histograms, corners.

_STRETCH = "lh AS (SELECT patch, min(v) AS lo, max(v) AS hi FROM px GROUP BY patch), st AS (SELECT patch, y, x, CASE WHEN hi > lo THEN round((v - lo) * 255.0 / (hi - lo)) ELSE 0 END::DOUBLE AS v FROM px JOIN lh USING (patch))"


def _sql_dft(source: str, tag: str) -> str:
    """CTE ``tag``: magnitudes with their place ``i``, ``j`` in the centred spectrum of 8 x 8 patches."""
    a, b = "2 * pi() * ((l * x) % 8) / 8", "2 * pi() * ((k * y) % 8) / 8"
    return f"""a{tag} AS (SELECT patch, y, l, sum(v * cos({a})) AS re, -sum(v * sin({a})) AS im FROM {source}, (SELECT unnest(range(8)) AS l) GROUP BY 1, 2, 3),
    b{tag} AS (SELECT patch, k, l, sum(re * cos({b}) + im * sin({b})) AS re, sum(im * cos({b}) - re * sin({b})) AS im FROM a{tag}, (SELECT unnest(range(8)) AS k) GROUP BY 1, 2, 3),
    {tag} AS (SELECT patch, (k + 4) % 8 AS i, (l + 4) % 8 AS j, sqrt(re * re + im * im) AS m FROM b{tag})"""


_HIGH = f"{_STRETCH}, {_sql_dft('st', 'ds')}, hf AS (SELECT patch, coalesce(sum(m) FILTER (WHERE NOT (i BETWEEN 3 AND 4 AND j BETWEEN 3 AND 4)), 0) / (sum(m) + 1e-6) AS high_frequency FROM ds GROUP BY patch)"


@query(f"""WITH {PIXELS}, {_sql_dft('px', 'dp')}, w AS (SELECT *, (i < 2)::INTEGER + (i >= 6)::INTEGER + (j < 2)::INTEGER + (j >= 6)::INTEGER AS n FROM dp),
    s AS (SELECT patch, avg(m) FILTER (WHERE i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5) AS fft_low, sum(m * n) / sum(n) AS fft_high FROM w GROUP BY patch) SELECT patch, {_r('fft_low', 'fft_high', 'fft_ratio=fft_high / (fft_low + 1e-6)')} FROM s""")
def patch_spectrum(spark, sf_dir):
    return rnd(spectra.spectrum_bands(spectra.dft(pixels(spark, sf_dir))))


@query(f"""WITH {PIXELS}, {_sql_near(1)}, {_GRAD}, {_HIGH}, q AS (SELECT patch, var_pop(lap) AS laplacian_var, avg(peak) AS peak_share, stddev_pop(sqrt(gx * gx + gy * gy)) AS roughness FROM gr GROUP BY patch)
    SELECT patch, {_r('laplacian_var', 'peak_share', 'roughness', 'high_frequency')} FROM q JOIN hf USING (patch)""")
def patch_quality(spark, sf_dir):
    return rnd(patches.family_table(pixels(spark, sf_dir), ["quality", "high_frequency"]))


def _sql_resized(height: int, width: int) -> str:
    """CTE ``rs``: area means of 8 x 8 patches, by the overlap of each pixel with each cell."""
    over = lambda c, cell, many: f"greatest(0, least(({cell} + 1) * {8 / many!r}, {c} + 1) - greatest({cell} * {8 / many!r}, {c})) / {8 / many!r}"
    return f"rs AS (SELECT patch, i::INTEGER AS y, j::INTEGER AS x, sum(v * {over('y', 'i', height)} * {over('x', 'j', width)}) AS v FROM px, (SELECT unnest(range({height})) AS i), (SELECT unnest(range({width})) AS j) GROUP BY 1, 2, 3)"


@query(f"WITH {PIXELS}, {_sql_resized(6, 5)} SELECT patch, y, x, {_r('v')} FROM rs")
def patch_resized(spark, sf_dir):
    return rnd(spectra.resized(pixels(spark, sf_dir), 6, 5))


def _sql_resized_whole(height: int, width: int) -> str:
    """CTE ``rs``: the same with overlaps as whole eighths, so that level areas have equal means and no gradient by rounding."""
    over = lambda c, cell, many: f"greatest(0, least(({cell} + 1) * 8, ({c} + 1) * {many}) - greatest({cell} * 8, {c} * {many}))"
    return f"rs AS (SELECT patch, i::INTEGER AS y, j::INTEGER AS x, sum(v * {over('y', 'i', height)} * {over('x', 'j', width)}) / 64.0::DOUBLE AS v FROM px, (SELECT unnest(range({height})) AS i), (SELECT unnest(range({width})) AS j) GROUP BY 1, 2, 3)"


@query(f"""WITH {PIXELS}, {_sql_resized_whole(13, 12)}, g AS (SELECT c.patch, c.y, c.x, CASE WHEN c.x BETWEEN 1 AND 10 THEN max(CASE WHEN n.x = c.x + 1 THEN n.v END) - max(CASE WHEN n.x = c.x - 1 THEN n.v END) ELSE 0 END AS gx,
        CASE WHEN c.y BETWEEN 1 AND 11 THEN max(CASE WHEN n.y = c.y + 1 THEN n.v END) - max(CASE WHEN n.y = c.y - 1 THEN n.v END) ELSE 0 END AS gy FROM rs c JOIN rs n ON n.patch = c.patch AND abs(n.y - c.y) + abs(n.x - c.x) = 1 GROUP BY 1, 2, 3),
    t AS (SELECT patch, y // 4 AS cy, x // 4 AS cx, (floor(round((((degrees(atan2(gy, gx)) % 180) + 180) % 180) / 20, 9)) % 9)::INTEGER AS bin, sqrt(gx * gx + gy * gy) AS m FROM g WHERE y < 12),
    c AS (SELECT patch, cy, cx, bin, sum(m) / 16 AS v FROM t GROUP BY 1, 2, 3, 4 HAVING sum(m) > 0), b AS (SELECT patch, b_y, b_x, cy - b_y AS cell_y, cx - b_x AS cell_x, bin, v FROM c, (SELECT unnest(range(2)) AS b_y), (SELECT unnest(range(2)) AS b_x) WHERE cy - b_y IN (0, 1) AND cx - b_x IN (0, 1)),
    n AS (SELECT * REPLACE (least(0.2, v / sqrt(sum(v * v) OVER (PARTITION BY patch, b_y, b_x) + 1e-10)) AS v) FROM b)
    SELECT patch, b_y AS block_y, b_x AS block_x, cell_y, cell_x, bin, {_r('value=v / sqrt(sum(v * v) OVER (PARTITION BY patch, b_y, b_x) + 1e-10)')} FROM n""")
def patch_hog_blocks(spark, sf_dir):
    """Patches brought to 13 x 12 pixels; the last row is beyond the last whole cell."""
    return rnd(spectra.hog_blocks(spectra.resized(pixels(spark, sf_dir), 13, 12)))


def _mirror(p: str) -> str:
    return f"CASE WHEN {p} < 0 THEN -({p}) WHEN {p} > 7 THEN 14 - ({p}) ELSE {p} END"


def _sql_mirrored(source: str, tag: str) -> str:
    """CTE ``tag``: gradients of all places, with the pixels behind the border beyond it."""
    return _sql_slopes(source, tag).replace("least(7, greatest(0, c.y + dy))", _mirror("c.y + dy")).replace("least(7, greatest(0, c.x + dx))", _mirror("c.x + dx"))


def _sql_corners(source: str) -> str:
    """CTEs ``dr`` and ``ch``: spread of direction, and share of corners."""
    return f"""{_sql_mirrored(source, 'ms')}, tn2 AS (SELECT c.patch, c.y, c.x, sum(n.gx * n.gx) AS a, sum(n.gy * n.gy) AS b, sum(n.gx * n.gy) AS c2 FROM ms c CROSS JOIN (VALUES (0, 0), (0, -1), (-1, 0), (-1, -1)) o(dy, dx)
        JOIN ms n ON n.patch = c.patch AND n.y = {_mirror('c.y + dy')} AND n.x = {_mirror('c.x + dx')} GROUP BY 1, 2, 3), rr AS (SELECT patch, a * b - c2 * c2 - 0.04::DOUBLE * (a + b) * (a + b) AS q FROM tn2),
    mx2 AS (SELECT patch, max(q) AS top FROM rr GROUP BY patch), ch AS (SELECT patch, avg((q > 0.01::DOUBLE * top)::INTEGER) AS corner_density FROM rr JOIN mx2 USING (patch) GROUP BY patch), dr AS (SELECT patch, stddev_pop(atan2(gy, gx)) AS direction_std FROM ms GROUP BY patch)"""


@query(f"WITH {PIXELS}, {_sql_corners('px')} SELECT patch, {_r('direction_std', 'corner_density')} FROM dr JOIN ch USING (patch)")
def patch_corners(spark, sf_dir):
    return rnd(regions.corners(patches.dealt(pixels(spark, sf_dir))))


# Frame measures; colour patches of 8 x 8 pixels stand for frames.

_LAB = "lin AS (SELECT *, " + ", ".join(f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92::DOUBLE END AS l{c}" for c in "rgb") + " FROM hs), "
_LAB += "xz AS (SELECT *, " + ", ".join("0.0 + " + " + ".join(f"l{c} * {w!r}::DOUBLE" for c, w in zip("rgb", ws)) + f" AS c{n}" for n, ws in frames.XYZ.items()) + " FROM lin), "
_LAB += "cv AS (SELECT *, " + ", ".join(f"CASE WHEN c{n} > 0.008856 THEN cbrt(c{n}) ELSE 7.787::DOUBLE * c{n} + 16 / 116::DOUBLE END AS f{n}" for n in "xyz") + " FROM xz), lb AS (SELECT *, least(255, greatest(0, round(500 * (fx - fy) + 128))) AS la, least(255, greatest(0, round(200 * (fy - fz) + 128))) AS lbb FROM cv)"
_WARM = "(h < 25 OR h > 160) AND val > 180 AND s > 60"
_GRAYPX = "gp AS (SELECT patch, y, x, v::INTEGER AS v FROM hs)"
_SHARP = f"{_GRAYPX}, {_sql_mirrored('gp', 'sl')}, sp AS (SELECT patch, stddev_pop(lap) AS sharpness FROM sl GROUP BY patch)"


@query(f"""WITH {COLOURS}, {_SHARP}, q AS (SELECT patch, avg(v) FILTER (WHERE free) AS mean_brightness, stddev_pop(v) FILTER (WHERE free) AS std_brightness, 100 * avg(({_WARM})::INTEGER) AS warm_pixel_ratio, avg((val > 200 AND s > 80)::INTEGER) FILTER (WHERE free) AS bright_saturated_frac
    FROM (SELECT *, (y - 3) ** 2 + (x - 5) ** 2 > 1 AS free FROM hs) GROUP BY patch) SELECT patch, {_r('mean_brightness', 'std_brightness', 'warm_pixel_ratio', 'bright_saturated_frac', 'sharpness')} FROM q JOIN sp USING (patch)""")
def frame_quality(spark, sf_dir):
    return rnd(frames.frame_quality(colours(spark, sf_dir), 8, 8))


_DETAILS = {
    "mean_brightness": "avg(v) FILTER (WHERE free)", "std_brightness": "stddev_pop(v) FILTER (WHERE free)", "dark_fraction": "avg((v < 40)::INTEGER) FILTER (WHERE free)", "bright_fraction": "avg((v > 220)::INTEGER) FILTER (WHERE free)",
    "lr_signed": "avg(v) FILTER (WHERE x < 2) - avg(v) FILTER (WHERE x >= 5)", "tb_signed": "avg(v) FILTER (WHERE y < 2) - avg(v) FILTER (WHERE y >= 5)", "sky_brightness": "avg(v) FILTER (WHERE y < 1)",
    "p10_brightness": "quantile_cont(v, 0.1) FILTER (WHERE free)", "p90_brightness": "quantile_cont(v, 0.9) FILTER (WHERE free)", "warm_bright_fraction": f"avg(({_WARM})::INTEGER) FILTER (WHERE free)", "bright_saturated_frac": "avg((val > 200 AND s > 80)::INTEGER) FILTER (WHERE free)",
    "sky_blue_ratio": "avg(b) FILTER (WHERE y < 1) / (avg(r) FILTER (WHERE y < 1) + 1)", "mean_saturation": "avg(s) FILTER (WHERE free)", "mean_hue": "avg(h) FILTER (WHERE free)", "br_ratio": "(avg(b) + 1) / (avg(r) + 1)", "mean_a": "avg(la)", "mean_b": "avg(lbb)",
    "overexposed_pct": "100 * avg((val > 250)::INTEGER) FILTER (WHERE y < 2)",
}


@query(f"""WITH {COLOURS}, {_SHARP}, {_LAB}, z AS (SELECT *, (y - 3) ** 2 + (x - 4) ** 2 > 0 AS free FROM lb), q AS (SELECT patch, {', '.join(f'{e} AS {n}' for n, e in _DETAILS.items())} FROM z GROUP BY patch),
    c AS (SELECT patch, v, count(*) AS n FROM z WHERE free GROUP BY 1, 2), e AS (SELECT patch, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM c GROUP BY patch)
    SELECT patch, {_r(*_DETAILS, 'dynamic_range=p90_brightness - p10_brightness', 'lr_asymmetry=abs(lr_signed)', 'tb_asymmetry=abs(tb_signed)', 'entropy', 'sharpness')} FROM q JOIN e USING (patch) JOIN sp USING (patch)""")
def frame_details(spark, sf_dir):
    return rnd(frames.frame_details(colours(spark, sf_dir), 8, 8))


@query(f"""WITH {COLOURS} SELECT patch, {', '.join(f"round({e} + 1e-9, 1) + 0.0 AS {n}" for n, e in (("sat_mean", "avg(s)"), ("val_mean", "avg(val)"), ("val_std", "stddev_pop(val)"), ("overexposed_pct", "100 * avg((val > 250)::INTEGER)"), ("gray_pct", "100 * avg((s < 30 AND val > 150)::INTEGER)")))},
    round(avg(b / (r + g + b + 1e-6)) + 1e-9, 3) + 0.0 AS blue_ratio FROM hs WHERE y < 2 GROUP BY patch""")
def frame_sky(spark, sf_dir):
    return frames.frame_sky(colours(spark, sf_dir), 8)


# Extractor and clusterer, for all units at once; a label stands for a unit, ten vectors for a frame.

_EPS = {"raw": 1.15, "statistics": 12.0}
_VECTORS = f"""{PIXELS}, fv AS (SELECT patch, 'raw' AS extractor, 1.15 AS eps, list(v / 255.0::DOUBLE ORDER BY y, x) AS f FROM px GROUP BY patch
    UNION ALL SELECT patch, 'statistics', 12.0, [avg(v), stddev_pop(v), min(v)::DOUBLE, max(v)::DOUBLE, quantile_cont(v, 0.25), quantile_cont(v, 0.75)] FROM px GROUP BY patch), fu AS (SELECT fv.*, label AS unit FROM fv JOIN embeddings ON vec_id = patch)"""


def _units(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch"), F.col("label").alias("unit"), F.floor(F.col("vec_id") / 10).alias("frame"))


@query(f"WITH {_VECTORS} SELECT DISTINCT extractor, patch // 10 AS frame, unit FROM fu a WHERE NOT EXISTS (SELECT 1 FROM fu b WHERE b.extractor = a.extractor AND b.unit = a.unit AND b.patch <> a.patch AND list_distance(a.f, b.f) <= a.eps)")
def facet_noise(spark, sf_dir):
    """The units that are noise in each frame, by two extractors and DBSCAN."""
    px, units = pixels(spark, sf_dir), _units(spark, sf_dir)
    parts = [pluggable.noise_of_frames(pluggable.process(px, units, name, pluggable.by_dbscan(eps, 2)), units).select(F.lit(name).alias("extractor"), "frame", "unit") for name, eps in _EPS.items()]
    return parts[0].unionByName(parts[1])


@query()
def facet_clusters(spark, sf_dir):
    """Cluster sizes of each unit, by two extractors times DBSCAN and k-means."""
    px, units = pixels(spark, sf_dir), _units(spark, sf_dir)
    parts = []
    for name, eps in _EPS.items():
        vectors = cut(pluggable.vectors(px, units, name))  # once for both clusterers
        for clusterer, by in (("dbscan", pluggable.by_dbscan(eps, 2)), ("kmeans", pluggable.by_kmeans(3))):
            sizes = by(vectors).groupBy("unit", "cluster").agg(F.count("*").alias("n"))
            parts.append(sizes.select(F.lit(name).alias("extractor"), F.lit(clusterer).alias("clusterer"), "unit", "cluster", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Colour sets with entropy and gradient of the gray level.

_SLOPE = f"{_GRAYPX}, {_sql_mirrored('gp', 'sl')}, sg AS (SELECT patch, avg(sqrt(gx * gx + gy * gy)) AS gradient FROM sl GROUP BY patch), lc AS (SELECT patch, v, count(*) AS n FROM gp GROUP BY 1, 2), en AS (SELECT patch, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM lc GROUP BY patch)"


@query(f"WITH {COLOURS}, {_SLOPE}, q AS (SELECT patch, {_r(*(x for c in 'rgb' for x in _moments(c, c + '_')), 'p75=quantile_cont(v, 0.75)', 'bright=avg((v > 200)::INTEGER)', 'dark=avg((v < 50)::INTEGER)')} FROM hs GROUP BY patch) SELECT q.*, {_r('entropy=en.entropy', 'gradient=sg.gradient')} FROM q JOIN en USING (patch) JOIN sg USING (patch)")
def patch_colour_stats(spark, sf_dir):
    return rnd(colour.channel_stats(colours(spark, sf_dir)))


@query(f"""WITH {COLOURS}, {_SLOPE}, n AS (SELECT patch, floor(v / 8) AS bin, count(*) AS n FROM hs GROUP BY 1, 2), e AS (SELECT patch, -sum(n / 64.0 * log2(n / 64.0)) AS entropy32 FROM n GROUP BY patch), q AS (SELECT patch, avg(s) AS saturation, {', '.join(f"{x.partition('=')[2]} AS {x.partition('=')[0]}" for x in _moments('v', 'g_'))} FROM hs GROUP BY patch)
    SELECT patch, {_r('luminance=g_mean', 'saturation', 'variance=g_std * g_std', 'skew=g_skew', 'entropy32', 'gradient')} FROM q JOIN e USING (patch) JOIN sg USING (patch)""")
def patch_small_set(spark, sf_dir):
    return rnd(colour.small_set(colours(spark, sf_dir)))


# Image archives: vectors become the tiles of images, which are written, found, decoded and cut again.

_TILES = 10


def _images(spark, sf_dir) -> str:
    """A folder with one image of ten by ten patches for each hundred vectors; a file is written whole by one task, and alike when that is repeated."""
    path = scratch(spark, "images")
    tiles = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / _TILES**2).alias("frame"), (F.col("vec_id") % _TILES**2).cast("int").alias("k"), F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 255))).cast("int")).alias("v"))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        side = 8 * _TILES
        img = np.zeros((side, side), np.uint8)
        for k, v in zip(rows["k"], rows["v"]):
            y, x = 8 * (k // _TILES), 8 * (k % _TILES)
            img[y : y + 8, x : x + 8] = np.array(v).reshape(8, 8)
        fs, place = pafs.FileSystem.from_uri(path)
        fs.create_dir(place, recursive=True)
        name = f"IRCamM1T{int(rows['frame'].iloc[0]):08d}_120000M.png"
        with fs.open_output_stream(f"{place}/{name}") as out:
            out.write(png(img))
        return pd.DataFrame({"name": [name]})

    tiles.groupBy("frame").applyInPandas(write, "name string").agg(F.count("*")).collect()
    return path


def png(img: np.ndarray) -> bytes:
    """A gray PNG file."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.hstack([np.zeros((len(img), 1), np.uint8), img]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def _archive(spark, sf_dir):
    """Gray pixels of the written images, with the number in their name."""
    rows = colour.gray(images.frame_pixels(images.read_frames(spark, _images(spark, sf_dir), "*.png")), key="frame")
    return rows.withColumn("frame", F.regexp_extract("frame", r"T(\d{8})_", 1).cast("long"))


_MOSAIC = f"""{PIXELS}, fm AS (SELECT DISTINCT patch // 100 AS frame FROM px), gd AS (SELECT frame, y, unnest(range(80)) AS x FROM (SELECT frame, unnest(range(80)) AS y FROM fm)),
    im AS (SELECT gd.frame, gd.y, gd.x, coalesce(px.v, 0) AS v FROM gd LEFT JOIN px ON px.patch = gd.frame * 100 + (gd.y // 8) * 10 + gd.x // 8 AND px.y = gd.y % 8 AND px.x = gd.x % 8)"""


@query(f"WITH {_MOSAIC} SELECT frame, y::INTEGER AS y, x::INTEGER AS x, v FROM im")
def image_pixels(spark, sf_dir):
    """Images are written, found by their name, decoded, and brought to gray."""
    return _archive(spark, sf_dir)


@query(f"WITH {_MOSAIC}, {_FACETS}, {_sql_raster(4)}, t AS (SELECT im.frame, pp.key, pp.y - bx.yl AS y, pp.x - bx.xl AS x, im.v FROM pp JOIN bx ON bx.key = pp.key JOIN im ON im.y = pp.y AND im.x = pp.x) SELECT key AS mirror_id, y, x, count(*) AS n_frames, sum(v)::BIGINT AS total FROM t GROUP BY ALL")
def stored_crops(spark, sf_dir):
    """Facets are cut from all written images, stored by facet and read again: their summed image."""
    path = scratch(spark, "crops")
    crops = raster.cut_facets(_archive(spark, sf_dir), _facets(spark, sf_dir)).withColumnRenamed("key", "mirror_id")
    store.write_crops(crops, path)
    rows = store.read_table(spark, path)
    return rows.groupBy(F.col("mirror_id").cast("int").alias("mirror_id"), "y", "x").agg(F.countDistinct("frame").alias("n_frames"), F.sum("v").alias("total"))


@query(f"""WITH {COLOURS}, px AS (SELECT patch, y, x, v::INTEGER AS v FROM hs), {_sql_near(2)}, {_sql_codes(16, 2)}, n AS (SELECT patch, (least(7, floor(h * 8 / 180)) * 16 + least(3, floor(s / 64)) * 4 + least(3, floor(val / 64)))::INTEGER AS bin, count(*) AS n FROM hs GROUP BY 1, 2)
    SELECT patch, bin, {_r('value=n / sqrt(sum(n * n) OVER (PARTITION BY patch))')} FROM n
    UNION ALL SELECT patch, (code + 128)::INTEGER, {_r('value=n / sum(n) OVER (PARTITION BY patch)')} FROM hc2""")
def patch_colour_hist(spark, sf_dir):
    return rnd(colour.colour_histogram(colours(spark, sf_dir)))


@query(f"""WITH RECURSIVE {PIXELS}, {_sql_near(1)}, {_sql_codes(8, 1)}, {_sql_near(2)}, {_sql_codes(16, 2)}, {_sql_near(3)}, {_sql_codes(24, 3)}, {_GRAD}, {_sql_slopes('px', 'sl')}, {_sql_canny('sl', 'ce')}, {_sql_glcm(32, 1, False, 4, 'a')}, {_sql_glcm(32, 3, False, 4, 'b')}, i AS (SELECT patch, avg(v) AS intensity_mean, stddev_pop(v) AS intensity_std FROM px GROUP BY patch),
    l1 AS (SELECT patch, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS lbp1_entropy FROM hc1 GROUP BY patch), l2 AS (SELECT patch, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS lbp2_entropy FROM hc2 GROUP BY patch), l3 AS (SELECT patch, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS lbp3_entropy FROM hc3 GROUP BY patch),
    ge AS (SELECT patch, avg(sqrt(gx * gx + gy * gy)) AS sobel_mean, avg(abs(lap)) AS laplacian_mean, stddev_pop(abs(lap)) AS laplacian_std FROM gr GROUP BY patch), ed AS (SELECT px.patch, count(ce.patch) / count(*) AS edge_density FROM px LEFT JOIN ce USING (patch, y, x) GROUP BY px.patch),
    """ + ", ".join(f"g{d} AS (SELECT patch, " + ", ".join(f"{f}({c}) AS glcm{d}_{c}_{n}" for c in ("contrast", "homogeneity", "energy") for n, f in (("mean", "avg"), ("std", "stddev_pop"))) + f" FROM cc{t} GROUP BY patch)" for d, t in ((1, "a"), (3, "b"))) + f"""
    SELECT patch, {_r('intensity_mean', 'intensity_std', 'lbp1_entropy', 'lbp2_entropy', 'lbp3_entropy', 'sobel_mean', 'laplacian_mean', 'laplacian_std', 'edge_density', *(f'glcm{d}_{c}_{n}' for d in (1, 3) for c in ('contrast', 'homogeneity', 'energy') for n in ('mean', 'std')))} FROM i JOIN l1 USING (patch) JOIN l2 USING (patch) JOIN l3 USING (patch) JOIN ge USING (patch) JOIN ed USING (patch) JOIN g1 USING (patch) JOIN g3 USING (patch)""")
def patch_texture(spark, sf_dir):
    return rnd(patches.family_table(pixels(spark, sf_dir), ["texture"]))


@query(f"""WITH RECURSIVE {PIXELS}, {_MASK}, {_sql_near(1)}, k1 AS (SELECT patch, y, x, {_sql_points(8, 1)} FROM nb1),
    co AS (SELECT a.patch, a.y, a.x FROM mk a JOIN mk b ON b.patch = a.patch AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 9), hc AS (SELECT patch, code, count(*) AS n FROM (SELECT patch, y, x, {_sql_code(8)} AS code FROM k1) JOIN co USING (patch, y, x) GROUP BY 1, 2),
    ag AS (SELECT patch, sum(n)::BIGINT AS n, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS le, sum(CASE WHEN code = 9 THEN n ELSE 0 END) / sum(n) AS ln FROM hc GROUP BY patch)
    SELECT t.patch, coalesce(n, 0)::BIGINT AS core_pixels, {_r('lbp_entropy=CASE WHEN n >= 20 THEN le END', 'lbp_nonuniform=CASE WHEN n >= 20 THEN ln END')} FROM tp t LEFT JOIN ag USING (patch)""")
def patch_masked_lbp(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return rnd(regions.masked_lbp(px, regions.patch_mask(px, MASK_ABOVE)))


@query(f"""WITH RECURSIVE {COLOURS}, a AS (SELECT patch, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(h) AS hm, stddev_pop(h) AS hd, avg(s) AS sm, stddev_pop(s) AS sd, avg(val) AS vm, stddev_pop(val) AS vd, 1 - 1 / (1 + var_pop(v)) AS smoothness FROM hs GROUP BY patch),
    n AS (SELECT patch, floor(h * 16 / 180)::INTEGER AS bin, count(*) AS n FROM hs GROUP BY 1, 2), e AS (SELECT patch, -sum(n / (64 + 1e-6) * log2(n / (64 + 1e-6) + 1e-6)) AS hue_entropy, arg_max(bin, n * 100 - bin) AS hue_peak FROM n GROUP BY patch),
    w AS (SELECT patch, v, count(*) AS n FROM hs GROUP BY 1, 2), u AS (SELECT patch, sum((n / (64 + 1e-6)) ** 2) AS uniformity FROM w GROUP BY patch), px AS (SELECT patch, y, x, v::INTEGER AS v FROM hs),
    {_sql_near(1)}, {_sql_codes(8, 1)}, lt AS (SELECT patch, sum(n) AS t FROM hc1 GROUP BY patch), lb AS (SELECT patch, {', '.join(f"coalesce(max(CASE WHEN code = {k} THEN n END), 0) / any_value(t) AS lbp_bin_{k}" for k in range(5))} FROM hc1 JOIN lt USING (patch) GROUP BY patch),
    {_sql_glcm(64, 1, True, 1, 'g')}, sh AS (SELECT patch, {', '.join(f"{e.partition('=')[2]} AS {e.partition('=')[0].replace('skew', 'skewness').replace('kurt', 'kurtosis')}" for c in 'rgb' for e in _moments(c, c + '_')[2:])} FROM hs GROUP BY patch),
    {_sql_dft('px', 'dp')}, wd AS (SELECT *, (i < 2)::INTEGER + (i >= 6)::INTEGER + (j < 2)::INTEGER + (j >= 6)::INTEGER AS n FROM dp), sb AS (SELECT patch, avg(m) FILTER (WHERE i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5) AS fft_low, sum(m * n) / sum(n) AS fft_high FROM wd GROUP BY patch),
    {_sql_slopes('px', 'sl')}, {_sql_canny('sl', 'ce')}, ed AS (SELECT px.patch, count(ce.patch) / count(*) AS edge_density FROM px LEFT JOIN ce USING (patch, y, x) GROUP BY px.patch), {_sql_corners('px')},
    sm AS (SELECT patch, sum(v)::DOUBLE AS m, sum(v * x)::DOUBLE AS mx, sum(v * y)::DOUBLE AS my, sum(v * x * x)::DOUBLE AS mxx, sum(v * y * y)::DOUBLE AS myy FROM px GROUP BY patch)
    SELECT patch, {_r('r_ratio=r / (r + g + b)', 'g_ratio=g / (r + g + b)', 'b_ratio=b / (r + g + b)', 'rg_ratio=r / (g + 1e-6)', 'rb_ratio=r / (b + 1e-6)', 'gb_ratio=g / (b + 1e-6)', 'hue_mean=hm', 'hue_std=hd', 'sat_mean=sm.sd2', 'sat_std=a.sd', 'val_mean=vm', 'val_std=vd', 'hue_entropy', 'uniformity', 'smoothness').replace('sm.sd2', 'a.sm')}, hue_peak,
        {_r(*(f'lbp_bin_{k}' for k in range(5)), *_FIVE, *(f'{c}_{k}' for c in 'rgb' for k in ('skewness', 'kurtosis')), 'fft_low', 'fft_high', 'fft_ratio=fft_high / (fft_low + 1e-6)', 'edge_density', 'direction_std', 'corner_density', 'moment_x=(mxx - mx * mx / m) / (m * m + 1e-6)', 'moment_y=(myy - my * my / m) / (m * m + 1e-6)')}
    FROM a JOIN e USING (patch) JOIN u USING (patch) JOIN lb USING (patch) JOIN ccg USING (patch) JOIN sh USING (patch) JOIN sb USING (patch) JOIN ed USING (patch) JOIN dr USING (patch) JOIN ch USING (patch) JOIN sm USING (patch)""")
def patch_advanced(spark, sf_dir):
    """The long colour and texture set."""
    return rnd(colour.advanced(colours(spark, sf_dir)))
