"""Spectra, resampling, block histograms, corners and frame measures against NumPy."""

import math
import random

import duckdb
import numpy as np
import pytest
from oracle import plain
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers all queries
from facetwatch.functions import frames, regions, spectra
from facetwatch.plans.queries import ORACLE_SQL, QUERIES


def images(seed=1):
    rng = np.random.default_rng(seed)
    sizes = [(8, 8), (9, 7), (16, 18), (12, 5), (4, 4), (1, 6), (3, 1), (20, 13)]
    return {k: rng.integers(0, 256, s) for k, s in enumerate(sizes)} | {50: np.full((8, 8), 77), 51: np.arange(64).reshape(8, 8) * 3}


def table(spark, imgs):
    return spark.createDataFrame([(k, y, x, int(v)) for k, a in imgs.items() for (y, x), v in np.ndenumerate(a)], "patch long, y int, x int, v int").repartition(5)


def test_spectrum_equals_fft(spark):
    imgs = images()
    got = {}
    for r in spectra.dft(table(spark, imgs)).collect():
        got.setdefault(r.patch, {})[r.k, r.l] = r.magnitude
    for k, a in imgs.items():
        want = np.abs(np.fft.fft2(a))
        assert len(got[k]) == a.size and all(math.isclose(m, want[at], rel_tol=1e-9, abs_tol=1e-6) for at, m in got[k].items())


def test_bands_equal_slices(spark):
    imgs = {k: a for k, a in images(2).items() if min(a.shape) >= 4}
    got = {r.patch: r for r in spectra.spectrum_bands(spectra.dft(table(spark, imgs))).collect()}
    high = {r.patch: r.high_frequency for r in spectra.high_frequency(table(spark, imgs)).collect()}
    for k, a in imgs.items():
        m, (h, w) = np.abs(np.fft.fftshift(np.fft.fft2(a))), a.shape
        low = m[h // 2 - 2 : h // 2 + 2, w // 2 - 2 : w // 2 + 2].mean()
        border = np.concatenate([m[:2].ravel(), m[-2:].ravel(), m[:, :2].ravel(), m[:, -2:].ravel()]).mean()
        assert np.allclose([got[k].fft_low, got[k].fft_high, got[k].fft_ratio], [low, border, border / (low + 1e-6)], atol=1e-6)
        s = np.floor((a - a.min()) * 255 / (a.max() - a.min()) + 0.5) if a.max() > a.min() else a * 0
        m, mid = np.abs(np.fft.fftshift(np.fft.fft2(s))), np.zeros(a.shape, bool)
        mid[h // 2 - h // 6 : h // 2 + h // 6, w // 2 - w // 6 : w // 2 + w // 6] = True
        assert math.isclose(high[k], m[~mid].sum() / (m.sum() + 1e-6), abs_tol=1e-9)


@pytest.mark.parametrize("size", [(18, 16), (5, 3), (1, 1), (9, 9)])
def test_resizing_keeps_area_means(spark, size):
    def weights(n, m):
        return np.array([[max(0.0, min((i + 1) * n / m, k + 1) - max(i * n / m, k)) * m / n for k in range(n)] for i in range(m)])

    imgs = images(3)
    got = {}
    for r in spectra.resized(table(spark, imgs), *size).collect():
        got.setdefault(r.patch, np.full(size, np.nan))[r.y, r.x] = r.v
    for k, a in imgs.items():
        assert np.allclose(got[k], weights(a.shape[0], size[0]) @ a @ weights(a.shape[1], size[1]).T)


def test_block_histograms_equal_plain_loops(spark):
    imgs = images(4)
    got = {}
    for r in spectra.hog_blocks(table(spark, imgs)).collect():
        got.setdefault((r.patch, r.block_y, r.block_x), {})[r.cell_y, r.cell_x, r.bin] = r.value
    for k, a in imgs.items():
        a = a.astype(float)
        gy, gx = np.zeros(a.shape), np.zeros(a.shape)
        gy[1:-1], gx[:, 1:-1] = a[2:] - a[:-2], a[:, 2:] - a[:, :-2]
        m, turn = np.hypot(gy, gx), np.degrees(np.arctan2(gy, gx)) % 180
        ny, nx = a.shape[0] // 4, a.shape[1] // 4
        h = np.zeros((ny, nx, 9))
        for y in range(ny * 4):
            for x in range(nx * 4):
                h[y // 4, x // 4, int(round(turn[y, x] / 20, 9)) % 9 if turn[y, x] / 20 % 1 > 1 - 1e-9 else int(turn[y, x] // 20) % 9] += m[y, x] / 16
        for i in range(ny - 1):
            for j in range(nx - 1):
                b = h[i : i + 2, j : j + 2].copy()
                b = np.minimum(b / np.sqrt((b**2).sum() + 1e-10), 0.2)
                b = b / np.sqrt((b**2).sum() + 1e-10)
                have = got.pop((k, i, j), {})
                assert all(math.isclose(have.get(at, 0.0), v, abs_tol=1e-9) for at, v in np.ndenumerate(b))
    assert not got


def mirrored(a, before=1, after=1):
    return np.pad(a, ((min(before, 1), after), (before, after)), mode="reflect") if min(a.shape) > 1 else np.pad(a, 1, mode="edge")


def test_corners_equal_numpy(spark):
    imgs = {k: a for k, a in images(5).items() if min(a.shape) > 1}
    got = {r.patch: r for r in regions.corners(table(spark, imgs)).collect()}
    for k, a in imgs.items():
        p = np.pad(a.astype(float), 1, mode="reflect")
        at = lambda y, x: p[1 + y : p.shape[0] - 1 + y, 1 + x : p.shape[1] - 1 + x]  # noqa: B023, E731
        gx = sum((2 - abs(d)) * (at(d, 1) - at(d, -1)) for d in (-1, 0, 1))
        gy = sum((2 - abs(d)) * (at(1, d) - at(-1, d)) for d in (-1, 0, 1))

        def box(q):
            q = np.pad(q, 1, mode="reflect")
            return sum(q[1 + y : q.shape[0] - 1 + y, 1 + x : q.shape[1] - 1 + x] for y in (0, -1) for x in (0, -1))

        xx, yy, xy = box(gx * gx), box(gy * gy), box(gx * gy)
        r = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
        assert math.isclose(got[k].corner_density, (r > 0.01 * r.max()).mean()) and math.isclose(got[k].direction_std, np.arctan2(gy, gx).std(), abs_tol=1e-9)


def colour_frames(spark, h=24, w=30, n=4):
    rng = np.random.default_rng(9)
    imgs = {k: rng.integers(0, 256, (h, w, 3)) for k in range(n)}
    imgs[10] = np.zeros((h, w, 3), int)
    imgs[11] = np.full((h, w, 3), 255)
    rows = [(k, y, x, *map(int, a[y, x])) for k, a in imgs.items() for y in range(h) for x in range(w)]
    return imgs, spark.createDataFrame(rows, "patch long, y int, x int, r int, g int, b int").repartition(6)


def test_frame_details_equal_numpy(spark):
    imgs, px = colour_frames(spark)
    got = {r.patch: r for r in frames.frame_details(px, 24, 30).collect()}
    for k, a in imgs.items():
        r, g, b = (a[..., i].astype(float) for i in range(3))
        v = np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)
        y, x = np.indices(v.shape)
        free = (y - 9) ** 2 + (x - 15) ** 2 > 4
        p10, p90 = np.percentile(v[free], [10, 90])
        n = np.bincount(v[free].astype(int), minlength=256) / free.sum()
        p = np.pad(v, 1, mode="reflect")
        lap = p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * v
        want = {
            "mean_brightness": v[free].mean(), "std_brightness": v[free].std(), "p10_brightness": p10, "p90_brightness": p90, "dynamic_range": p90 - p10, "dark_fraction": (v[free] < 40).mean(), "bright_fraction": (v[free] > 220).mean(),
            "lr_signed": v[:, :10].mean() - v[:, 20:].mean(), "tb_signed": v[:8].mean() - v[16:].mean(), "sky_brightness": v[:4].mean(), "sky_blue_ratio": b[:4].mean() / (r[:4].mean() + 1), "br_ratio": (b.mean() + 1) / (r.mean() + 1),
            "overexposed_pct": 100 * (a.max(axis=2)[:8] > 250).mean(), "entropy": -(n[n > 0] * np.log2(n[n > 0])).sum(), "sharpness": lap.std(),
        }
        for name, value in want.items():
            assert math.isclose(got[k][name], value, rel_tol=1e-6, abs_tol=1e-6), (k, name)
        assert got[k].lr_asymmetry == abs(got[k].lr_signed)
    assert abs(got[11].mean_a - 128) <= 1 and abs(got[11].mean_b - 128) <= 1 and got[11].warm_bright_fraction == 0


def test_states_of_parts_add_up(spark):
    _, px = colour_frames(spark)
    rng = random.Random(3)
    parts = px.withColumn("part", (F.col("y") * 7 + F.col("x") * rng.randrange(1, 9)) % 3)
    whole = frames.brightness(frames.level_state(px, 24, 30, frames.HOUSING))
    split = frames.brightness(frames.merged(*(frames.level_state(parts.where(F.col("part") == k), 24, 30, frames.HOUSING) for k in range(3))))
    same = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*whole.columns).collect())
    assert same(whole) == same(split)


def test_block_histograms_of_level_areas_equal_sql(spark, tmp_path):
    """Flat, striped and two-level patches: a level area has no gradient, neither here nor in SQL."""
    rng = np.random.default_rng(3)
    levels = [np.full((8, 8), 77), np.tile(rng.integers(0, 256, 8), (8, 1)), np.tile(rng.integers(0, 256, (8, 1)), (1, 8)), rng.integers(0, 2, (8, 8)) * 133]
    rows = [(i, [float(v) for v in ((g + 0.5) / 255 - 0.5).ravel()], 0) for i, g in enumerate(levels)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES["patch_hog_blocks"](spark, str(tmp_path)).toPandas()
    assert plain(got) == plain(con.execute(ORACLE_SQL["patch_hog_blocks"]).df())
    assert 0 not in set(got["patch"])


def test_resized_flat_patches_stay_flat(spark):
    imgs = {k: np.full(size, 77) for k, size in enumerate([(9, 7), (18, 11), (13, 12), (6, 23)])}
    assert {r.v for r in spectra.resized(table(spark, imgs), 13, 12).select("v").collect()} == {77.0}
