import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetwatch.operators import baseline, metrics, ml, score, selection, temporal


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(7)
    rows = [(f"f{t:02d}", u, float(rng.normal(u, 1)), float(rng.normal(5, 2)), float(rng.normal(0, 1))) for t in range(30) for u in range(6)]
    rows[5] = ("f00", 5, float("nan"), 5.0, 0.0)
    rows[9] = ("f01", 3, 100.0, 5.0, 0.0)
    return spark.createDataFrame(rows, "frame string, unit int, a double, b double, c double").cache()


def column(df, unit, name):
    return [r[name] for r in df.where(F.col("unit") == unit).collect()]


def test_robust_baseline_skips_nan(obs):
    got = {(r.unit, r.feature): r for r in baseline.robust_baseline(obs, "unit", ["a", "b"]).collect()}
    for u in range(6):
        x = np.array(column(obs, u, "a"))
        med = np.nanmedian(x)
        assert got[u, "a"].median == pytest.approx(med) and got[u, "a"].mad == pytest.approx(1.4826 * np.nanmedian(abs(x - med)))
    near = {(r.unit, r.feature): r for r in baseline.robust_baseline(obs, "unit", ["a", "b"], approx=True).collect()}
    assert near[2, "b"].median == pytest.approx(got[2, "b"].median, abs=0.5)


def test_constant_feature_has_the_least_spread(spark):
    df = spark.createDataFrame([("f", 1, 3.0)] * 5, "frame string, unit int, a double")
    assert baseline.robust_baseline(df, "unit", ["a"]).first().mad == 1e-6


def test_vector_baseline_inverts(obs):
    keys = ["a", "b", "c"]
    got = {r.unit: r for r in baseline.vector_baseline(obs, "unit", keys).collect()}
    x = np.array([column(obs, 2, k) for k in keys]).T
    assert np.allclose(np.array(got[2].cov_inv).reshape(3, 3), np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(3)))
    assert np.allclose(got[2].std, x.std(axis=0)) and got[5].n_complete == 29
    d = score.mahalanobis(obs, baseline.vector_baseline(obs, "unit", keys), "unit", keys)
    v = x[0] - np.median(x, axis=0)
    want = math.sqrt(v @ np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(3)) @ v)
    assert d.where("unit = 2 and frame = 'f00'").first().mahalanobis == pytest.approx(want)
    assert d.where("unit = 5 and frame = 'f00'").first().mahalanobis is None


def test_vector_baseline_falls_back_to_variances(spark):
    rows = [(1, float(i), None if i else 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "unit int, a double, b double")
    r = baseline.vector_baseline(df, "unit", ["a", "b"]).first()
    assert np.array(r.cov_inv).reshape(2, 2)[0, 1] == 0 and r.cov_inv[0] == pytest.approx(1 / (np.arange(6).var() + 1e-6))


def test_vector_baseline_needs_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)] * 3, "unit int, a double, b double")
    with pytest.raises(Exception, match="needs 4 rows"):
        baseline.vector_baseline(df, "unit", ["a", "b"]).collect()


def test_outliers_and_votes(obs):
    z = score.z_scores(obs, baseline.robust_baseline(obs, "unit", ["a", "b"]), "frame", "unit", ["a", "b"])
    out = score.feature_outliers(z, 4.0)
    assert ("f01", 3, "a", "high") in {(r.frame, r.unit, r.feature, r.side) for r in out.collect()}
    assert not out.where("unit = 5 and frame = 'f00' and feature = 'a'").count(), "a missing value is no outlier"
    assert score.vote(out, "frame", "unit", "voting", 2).count() <= score.vote(out, "frame", "unit").count()
    with pytest.raises(ValueError):
        score.vote(out, "frame", "unit", "other")
    lists = score.outlier_lists(out, "unit", ["feature"]).collect()
    assert any(3 in r.units for r in lists)


def test_frame_cut_ignores_nan(obs):
    hit = {(r.frame, r.unit) for r in score.frame_cut(obs, "frame", "a", 1.5).collect()}
    assert ("f01", 3) in hit


def test_pair_report_text(spark):
    df = spark.createDataFrame([("x", 1, 0.0, 0.0), ("x", 2, 1.0, 5.0), ("y", 1, 4.0, 0.0), ("y", 2, 1.0, 5.0)], "frame string, unit int, a double, b double")
    diffs = score.frame_pair_diff(df, score.consecutive_pairs(df, "frame"), "frame", "unit", ["a", "b"])
    first = score.pair_report(diffs, "unit", ["a", "b"], top=1).first()
    both = np.array([0, 1, 4, 1.0])
    assert first.unit == 1 and first.reasons.startswith(f"a=+{4 / both.std():.2f}") and first.distance == pytest.approx(4 / both.std())


def test_ranks_average_ties(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate([3.0, 2.0, 2.0, 1.0, None])], "frame string, unit int, composite double")
    got = {r.unit: r["rank"] for r in temporal.rank_units(df, "frame").collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 4, 4: None}


def test_rank_sums_and_affine_invariance(obs):
    ranks = temporal.frame_rank(obs, "frame", "unit", ["a", "b"], ["b"])
    assert {r.s for r in ranks.groupBy("frame").agg(F.sum("rank").alias("s")).collect()} <= {21}
    other = temporal.frame_rank(obs.withColumn("a", F.col("a") * 3 + 7), "frame", "unit", ["a", "b"], ["b"])
    a, b = ({(r.frame, r.unit): r["rank"] for r in x.collect()} for x in (ranks, other))
    assert a == b


def test_longest_run(spark):
    df = spark.createDataFrame([(1, k, 10 if bad else 1) for k, bad in enumerate([1, 1, 0, 1, 1, 1], 1)], "unit int, frame_idx int, rank int")
    r = temporal.bottom_runs(df, "unit", 10).first()
    assert r.longest_run == 3 and r.pct_bad == pytest.approx(500 / 6)


def test_history_signals(spark):
    rows = [(f"f{t:02d}", 1, 5 if t < 15 else 5 + 6 * (t - 14)) for t in range(20)] + [("f00", 2, 3)]
    hist = temporal.with_counts(temporal.history(spark.createDataFrame(rows, "frame string, unit int, rank int"), "frame", "unit"), "unit")
    drop = temporal.rank_drop(hist, "unit").collect()
    assert [r.unit for r in drop] == [1] and drop[0].drop == pytest.approx((23 - 5) / 5)
    assert temporal.rank_trend(hist, "unit").first().slope == pytest.approx(6)
    assert temporal.rank_drop(hist, "unit", warn=True).where("unit = 2").count() == 0, "one frame is no history"


def test_p_values():
    assert temporal.student_p(0.5, 10) == pytest.approx(0.0222, abs=1e-4)
    assert temporal.student_p(0.0, 10) == 1.0 and temporal.student_p(1.0, 10) == 0.0 and math.isnan(temporal.student_p(0.5, 2))


def test_detection_counts(spark):
    p = spark.createDataFrame([("f", i) for i in (150, 155, 160, 190, 191, 191)], "frame string, unit int")
    t = spark.createDataFrame([("f", i) for i in (152, 176, 189, 190, 191, 192, 193, 209)], "frame string, unit int")
    r = metrics.detection_metrics(p, t, ["frame", "unit"]).first()
    assert (r.tp, r.fp, r.fn) == (2, 3, 6) and r.precision == 0.4 and r.recall == 0.25 and r.f1 == pytest.approx(0.3077, abs=1e-4) and r.iou == pytest.approx(2 / 11)
    none = metrics.detection_metrics(p.limit(0), t.limit(0), ["frame", "unit"]).first()
    assert (none.tp, none.precision, none.recall, none.f1, none.iou) == (0, 0, 0, 0, 0)


def test_average_precision(spark):
    s = spark.createDataFrame([("f", i, float(-i)) for i in range(6)], "frame string, unit int, score double")
    t = spark.createDataFrame([("f", i) for i in (0, 1, 2)] + [("g", 1)], "frame string, unit int")
    got = {r.frame: r.ap for r in metrics.average_precision(s, t, ["frame", "unit"], "score", ["frame"]).collect()}
    assert got == {"f": 1.0, "g": 0.0}
    assert {r.frame: r.recall for r in metrics.recall_at_k(s, t, ["frame", "unit"], "score", ["frame"], 2).collect()}["f"] == pytest.approx(2 / 3)


def test_dbscan_and_forest(spark):
    x = np.concatenate([np.zeros((5, 2)), np.ones((5, 2)) * 10, [[50.0, 50.0]]])
    assert ml.dbscan_labels(x, 1.0, 2).tolist() == [0] * 5 + [1] * 5 + [-1]
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(0, 1, (300, 2)), [[9.0, 9.0]]])
    assert ml.isolation_scores(y, 50).argmax() == 300
    df = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(x)] + [(2, 0, None, 1.0)], "unit int, frame int, a double, b double")
    got = ml.dbscan(df, "unit", ["frame"], ["a", "b"], 1.0, 2)
    assert [r.frame for r in ml.noise(got).collect()] == [10] and got.where("unit = 2").first()["cluster"] is None


def test_pca_and_kmeans(spark):
    rng = np.random.default_rng(1)
    t = rng.normal(0, 5, 200)
    df = spark.createDataFrame([(i, float(v), float(2 * v + rng.normal(0, 0.1)), float(rng.normal())) for i, v in enumerate(t)], "id int, a double, b double, c double")
    share = [r.share for r in ml.explained(df, ["a", "b", "c"]).orderBy("component").collect()]
    assert share[0] == pytest.approx(2 / 3, abs=0.02) and sum(share) == pytest.approx(1)
    rows, centres = ml.kmeans(df, ["a", "b"], 2)
    assert centres.shape == (2, 2) and ml.cluster_sizes(rows).agg(F.sum("n")).first()[0] == 200


def test_weather_and_rules(spark):
    m = spark.createDataFrame([(50.0, 1.0, 1.0, 0.4), (10.0, 20.0, 50.0, 0.2)], "sat_mean double, overexposed_pct double, gray_pct double, blue_ratio double")
    a, b = selection.classify_weather(m).collect()
    assert a.verdict == "GOOD" and b.verdict == "BAD" and b.reasons.count(";") == 3
    q = spark.createDataFrame([(120.0, 0.01, 30.0), (120.0, None, 30.0)], "mean_brightness double, bright_saturated_frac double, sharpness double")
    assert selection.good_frames(q).count() == 1
    with pytest.raises(KeyError):
        selection.select_features(q, [], ["sharpness"], ["nothing"])
