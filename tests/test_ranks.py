"""Ranks and percentiles by range, the bounded bank, the chi-square cut and pixel rows of images against plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetwatch.functions import colours, patches
from facetwatch.operators import baseline, metrics, ml, ranks, score
from facetwatch.sources import images


def rows(spark, n=700):
    rng = np.random.default_rng(1)
    out = [("abc"[int(rng.integers(0, 3)) if i % 3 else 0], i, float(rng.integers(0, 40))) for i in range(n)]
    return out, spark.createDataFrame(out, "g string, id long, v double").repartition(7)


def test_ranks_and_running_sums(spark):
    data, df = rows(spark)
    got = {r.id: (r["_pos"], r.total) for r in ranks.ranked(df, ["g"], [F.desc("v"), F.col("id")], {"total": F.col("id")}).collect()}
    for g in "abc":
        own, total = sorted((-v, i) for h, i, v in data if h == g), 0
        for k, (_, i) in enumerate(own, 1):
            total += i
            assert got[i] == (k, total)


@pytest.mark.parametrize("by", [["g"], []])
def test_percentiles_equal_numpy(spark, by):
    data, df = rows(spark)
    at = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = {((r.g,) if by else (), r.percentile): r.value for r in baseline.score_percentiles(df.unionByName(df.limit(3).withColumn("v", F.lit(None).cast("double"))), "v", at, by or None).collect()}
    for g in [(x,) for x in "abc"] if by else [()]:
        own = [v for h, _, v in data if not by or h == g[0]]
        assert all(math.isclose(got[g, p], np.percentile(own, 100 * p)) for p in at)
    assert ranks.percentiles(df.limit(0), "v", at, by).collect() == []


def test_average_precision_of_a_large_source(spark):
    data, df = rows(spark)
    truth = {i for _, i, v in data if (i * 7) % 11 == 0}
    scored = df.select("g", "id", "v")
    got = {r.g: (r.n_truth, r.ap) for r in metrics.average_precision(scored, df.where(((F.col("id") * 7) % 11) == 0).select("g", "id"), ["g", "id"], "v", ["g"]).collect()}
    for g in "abc":
        hits, area = 0, 0.0
        for k, (_, i) in enumerate(sorted((-v, i) for h, i, v in data if h == g), 1):
            if i in truth:
                hits += 1
                area += hits / k
        assert got[g] == (hits, pytest.approx(area / hits))


def test_bank_matches_in_parts(spark):
    rng = np.random.default_rng(2)
    data = [(i % 3, i, [float(x) for x in rng.normal(size=9)]) for i in range(90)] + [(0, 200, [1.0] * 9), (0, 201, [float(k) for k in range(9)]), (0, 202, [float(k) for k in range(9)]), (5, 300, [float(k) for k in range(9)])]
    df = spark.createDataFrame(data, "unit int, id long, x array<double>")
    want = {}
    unit = lambda x: (np.array(x) - np.mean(x)) / np.linalg.norm(np.array(x) - np.mean(x))
    for u, i, x in data:
        held = [(j, float(unit(x) @ unit(y))) for w, j, y in data if w == u and (j < 45 or j == 202) and j != i and np.std(y) > 0] if np.std(x) > 0 else []
        if held:
            top = max(round(c, 12) for _, c in held)
            want[i] = (pytest.approx(top, abs=1e-9), pytest.approx(float(np.median([c for _, c in held])), abs=1e-9), min(j for j, c in held if round(c, 12) == top))
    for size in (50_000, 7):
        got = {r.id: (r.max_ncc, r.median_ncc, r.best_key) for r in patches.best_match(df, df.where("id < 45 or id = 202"), "unit", "id", "x", part_rows=size).collect()}
        assert got == want and 200 not in got and 300 not in got


def test_chi_square_cut_and_outliers(spark):
    for k, q in ((1, 5.0239), (2, 7.3778), (3, 9.3484), (10, 20.4832), (40, 59.3417)):
        assert math.isclose(ml.chi_square_quantile(k), q, abs_tol=2e-4)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in range(800)] + [(900, 9.0, -9.0, 9.0)], "id int, a double, b double, c double")
    out = {r.id for r in ml.pca_outliers(df, ["a", "b", "c"], 3).collect()}
    assert 900 in out and 5 < len(out) < 45


def test_pca_loadings_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) @ np.diag([3.0, 2.0, 1.0, 0.5]) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double, d double")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, axes = np.linalg.eigh(np.cov(z.T))
    got = ml.top_loadings(df, ["a", "b", "c", "d"], 2, top=4).collect()
    for r in got:
        assert math.isclose(r.loading, abs(axes[:, ::-1]["abcd".index(r.feature), r.component]), abs_tol=1e-9)
    assert [round(r.share, 9) for r in ml.explained(df, ["a", "b", "c", "d"]).orderBy("component").collect()] == [round(float(v), 9) for v in values[::-1] / values.sum()]


def test_vectors_far_from_all_prototypes(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5))
    df = spark.createDataFrame([(i % 4, [float(v) for v in r]) for i, r in enumerate(x)], "label int, e array<double>")
    centres = ml.prototypes(df, "e", 7)
    c = np.array([r.centre for r in centres.collect()])
    cos = (x @ c.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(c, axis=1)[None]).max(axis=1)
    got = {r.label: (r.n, r.n_ood) for r in ml.ood_counts(ml.out_of_distribution(df, centres, "e", 0.7), "label").collect()}
    assert got == {k: (50, int((cos[k::4] < 0.7).sum())) for k in range(4)}
    with pytest.raises(ValueError):
        ml.out_of_distribution(df, centres, "e", most=6)


def test_outlier_lists_as_rows(spark):
    df = spark.createDataFrame([("f", "a", 1), ("f", "a", 1), ("f", "a", 2), ("g", "b", 3)], "frame string, feature string, unit int")
    assert sorted(tuple(r) for r in score.outlier_rows(df, "unit", ["frame", "feature"]).collect()) == [("f", "a", 1, 2), ("f", "a", 2, 2), ("g", "b", 3, 1)]


def test_pixel_rows_of_frames(spark):
    bgr, gray = bytes(range(24)), bytes([7, 8, 9, 10, 11, 12])
    df = spark.createDataFrame([("c", 2, 4, 3, bgr), ("g", 3, 2, 1, gray), ("a", 1, 1, 4, b"\x01\x02\x03\xff"), ("bad", 2, 2, 3, b"\x01"), ("none", -1, -1, -1, b"")], "frame_id string, height int, width int, channels int, data binary")
    for at_once in (64, 1):
        got = sorted(tuple(r) for r in images.frame_pixels(df, at_once).collect())
        want = [("c", k // 4, k % 4, bgr[3 * k + 2], bgr[3 * k + 1], bgr[3 * k]) for k in range(8)] + [("g", k // 2, k % 2, v, v, v) for k, v in enumerate(gray)] + [("a", 0, 0, 3, 2, 1)]
        assert got == sorted(want)
    cut_off = {r.v for r in colours.gray(images.frame_pixels(df.where("frame_id = 'a'")), rounded=False, key="frame").collect()}
    assert cut_off == {2}


def test_bank_is_the_first_tenth_of_the_ids(spark, tmp_path):
    """The bank grows with the archive: of 6000 ids those below 600 are in it, and no others."""
    from facetwatch.plans.queries import QUERIES

    rng = np.random.default_rng(6)
    data = [(i, [float(v) for v in rng.normal(size=64)], i % 2) for i in range(6000)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    keys = {r.best_key for r in QUERIES["ncc_bank"](spark, str(tmp_path)).select("best_key").collect()}
    assert max(keys) < 600 and len(keys & set(range(400, 600))) > 150
