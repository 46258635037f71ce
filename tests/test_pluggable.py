"""Pluggable pipelines, k-means by group and the forest's node table against plain code."""

import duckdb
import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers all queries
from facetwatch.functions import patches
from facetwatch.operators import ml, nearness, pluggable
from facetwatch.plans.inputs import pixels
from facetwatch.plans.queries import QUERIES


def vectors(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(u, 100 * u + i, [float(v) for v in rng.normal(0, 1, 3) + 9 * (i % 4)]) for u in range(3) for i in range(40)]
    rows += [(0, 900, None), (None, 901, [0.0, 0.0, 0.0]), (1, 902, [0.0, None, 1.0]), (7, 903, [1.0, 1.0, 1.0]), (7, 904, [1.0, 1.0, 1.0])]
    return rows, spark.createDataFrame(rows, "unit int, patch long, features array<double>")


def test_grouped_kmeans_is_settled_and_nearest(spark):
    rows, df = vectors(spark)
    labels, centres = ml.grouped_kmeans(df, "unit", "patch", "features", 4, rounds=30)
    got = {r.patch: (r.unit, r.cluster) for r in labels.collect()}
    by = {}
    for r in centres.collect():
        by.setdefault(r.unit, {})[r.cluster] = np.array(r.centre)
    whole = {p: (u, np.array(x)) for u, p, x in rows if u is not None and x is not None and None not in x}
    assert set(got) == set(whole) and set(by) == {0, 1, 2, 7} and len(by[7]) == 1
    for p, (u, x) in whole.items():
        near = min(by[u], key=lambda c: (((x - by[u][c]) ** 2).sum(), c))  # noqa: B023
        assert got[p] == (u, near)
    for u, cs in by.items():
        for c, centre in cs.items():
            own = [x for p, (v, x) in whole.items() if v == u and got[p][1] == c]
            assert not own or np.allclose(np.mean(own, axis=0), centre)
    assert ml.grouped_kmeans(df.limit(0), "unit", "patch", "features")[0].collect() == []


def test_pipelines_take_names_and_functions(spark):
    rng = np.random.default_rng(2)
    px = spark.createDataFrame([(p, y, x, int(v)) for p in range(24) for (y, x), v in np.ndenumerate(np.clip(rng.normal(60 + 90 * (p % 2), 4, (8, 9)), 0, 255))], "patch long, y int, x int, v int")
    units = spark.range(24).select(F.col("id").alias("patch"), (F.floor(F.col("id") / 12)).alias("unit"), (F.col("id") % 12).alias("frame"))
    for name, size in (("raw", 72), ("small", 288), ("statistics", 6), ("hog", 36)):
        assert {r.n for r in pluggable.EXTRACTORS[name](px).select(F.size("features").alias("n")).collect()} == {size}
    halves = {r.patch: (r.unit, r.cluster) for r in pluggable.process(px, units, "statistics", pluggable.by_kmeans(2)).collect()}
    assert len(halves) == 24 and all((halves[p][1] == halves[q][1]) == (p % 2 == q % 2) for p in range(12) for q in range(12))
    own = pluggable.process(px, units, lambda rows: rows.groupBy("patch").agg(F.array(F.avg("v")).alias("features")), pluggable.by_dbscan(10.0, 3))
    assert own.groupBy("unit").agg(F.countDistinct("cluster").alias("n")).where("n = 2").count() == 2
    lonely = pluggable.process(px, units, "raw", pluggable.by_dbscan(0.0, 2))
    assert pluggable.noise_of_frames(lonely, units).count() == 24
    with pytest.raises(KeyError):
        pluggable.process(px, units, "none", "dbscan")


def test_raw_vectors_keep_raster_order(spark):
    px = spark.createDataFrame([(1, y, x, 10 * y + x) for y in range(3) for x in range(4)], "patch long, y int, x int, v int").repartition(6)
    assert pluggable.raw_pixels(px).first().features == [(10 * y + x) / 255 for y in range(3) for x in range(4)]


def test_scores_equal_a_walk_in_sql_over_the_stored_nodes(spark):
    rng = np.random.default_rng(4)
    rows = [(u, i, *map(float, rng.normal(0, 1 + u, 2))) for u in range(3) for i in range(90)] + [(0, 99, 8.0, 8.0), (5, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "unit int, frame int, a double, b double")
    nodes = ml.grow_forest(df, "unit", ["frame"], ["a", "b"], trees=12, sample=32)
    scores = ml.score_forest(df, nodes, "unit", ["frame"], ["a", "b"], part_rows=25)
    n, x, s = (t.toPandas() for t in (nodes, df, scores))  # noqa: F841  read by the query below
    want = duckdb.sql("""
        WITH RECURSIVE w AS (SELECT x.unit, frame, a, b, tree, 0 AS node FROM x JOIN (SELECT DISTINCT unit, tree FROM n) t ON t.unit = x.unit
            UNION ALL SELECT w.unit, frame, a, b, w.tree, CASE WHEN (CASE n.feature WHEN 0 THEN a ELSE b END) < n.threshold THEN n.below ELSE n.above END FROM w JOIN n ON n.unit = w.unit AND n.tree = w.tree AND n.node = w.node WHERE n.feature >= 0),
        d AS (SELECT w.unit, frame, avg(n.depth) AS depth, any_value(n.sampled) AS m FROM w JOIN n ON n.unit = w.unit AND n.tree = w.tree AND n.node = w.node WHERE n.feature < 0 GROUP BY 1, 2)
        SELECT unit, frame, pow(2.0, -depth / greatest(CASE WHEN m < 2 THEN 0 WHEN m = 2 THEN 1 ELSE 2 * (ln(m - 1) + 0.5772156649) - 2 * (m - 1) / m END, 1e-9)) AS score FROM d""").df()
    both = s.merge(want, on=["unit", "frame"])
    assert len(both) == len(rows) == len(s) and np.allclose(both.score_x, both.score_y)
    assert n.groupby(["unit", "tree", "node"]).size().max() == 1 and n.groupby("unit").tree.nunique().max() == 12
    top = s[s.unit == 0].sort_values("score").frame.iloc[-1]
    assert top == 99


def test_kmeans_in_blocks_equals_one_block(spark):
    _, df = vectors(spark, 3)
    one, many = (ml.grouped_kmeans(df, "unit", "patch", "features", 4, block_rows=n) for n in (4096, 7))
    assert {tuple(r) for r in one[0].collect()} == {tuple(r) for r in many[0].collect()}


def test_an_extractor_runs_once_for_both_clusterers(spark, monkeypatch):
    calls = []
    for name in ("raw", "statistics"):
        own = pluggable.EXTRACTORS[name]
        monkeypatch.setitem(pluggable.EXTRACTORS, name, lambda px, name=name, own=own: calls.append(name) or own(px))
    QUERIES["facet_clusters"](spark, DATA)
    assert sorted(calls) == ["raw", "statistics"]


def test_two_samples_take_distances_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = {g: rng.uniform(0, 9, (300, 2)) for g in (0, 1)}
    df = spark.createDataFrame([(g, i, [float(v) for v in row]) for g, m in x.items() for i, row in enumerate(m)], "unit int, patch long, features array<double>")
    passes, run = [], nearness._run
    monkeypatch.setattr(nearness, "_run", lambda *a: passes.append(a) or run(*a))
    got = {(r.unit, r.patch): r.cluster for r in ml.dbscan(df, "unit", ["patch"], "features", 0.3, 2).collect()}
    assert got == {(g, i): int(c) for g, m in x.items() for i, c in enumerate(ml.dbscan_labels(m, 0.3, 2))}
    assert len(passes) == 1 and len(set(got.values())) > 20 and -1 in got.values()


def test_rows_of_one_file_are_dealt_out_before_they_become_pixels(spark, monkeypatch):
    monkeypatch.setattr(patches, "PART_PIXELS", 1_000)
    sums = pixels(spark, DATA).groupBy("patch").agg(F.sum("v"))
    assert sums.count() == 500
    plan = sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ", 32), REPARTITION_BY_NUM" in plan and plan.count("hashpartitioning(") == 1
