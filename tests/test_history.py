"""Signals after the baseline, worked out by hand; neighbours, pairs, grids and clusters against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetwatch.operators import geometry, ml, nearness, score, selection, temporal
from facetwatch.schemas import ROW_SIZES


def signals(spark, ranks, n_units=100):
    """``ranks``: per unit a dict of frame number to rank."""
    rows = [(f"f{t:02d}", u, r) for u, by in ranks.items() for t, r in by.items()]
    hist = temporal.with_counts(temporal.history(spark.createDataFrame(rows, "frame string, unit int, rank int"), "frame", "unit"), "unit")
    return hist, {r.unit: r for r in temporal.unit_signals(hist, "unit", n_units).collect()}


def test_what_is_bad_in_the_baseline_alone_is_not_flagged(spark):
    hist, got = signals(spark, {1: {t: 95 if t < 4 else 50 for t in range(20)}, 2: {t: 95 if 12 <= t < 16 else 50 for t in range(20)}})
    assert (got[1].longest_run, got[1].pct_bad) == (0, 0.0)
    assert (got[2].longest_run, got[2].pct_bad, got[2].n_recent) == (4, 40.0, 10)
    assert [r.unit for r in temporal.bottom_runs(hist, "unit", 100).collect()] == [2]
    report = temporal.signal_report(temporal.unit_signals(hist, "unit", 100), "unit", top=None)
    assert [(r.signal, r.unit, r.severity) for r in report.collect()] == [("persistent", 2, 4.0)]
    assert [(r.unit, r.n_signals) for r in temporal.flagged_units(report, "unit").collect()] == [(2, 1)]


def test_trend_needs_a_window_after_the_baseline(spark):
    # Twelve frames: ten are the baseline, two are recent.
    hist, got = signals(spark, {1: {t: 5 + 3 * t for t in range(12)}})
    assert got[1].slope is None and temporal.rank_trend(hist, "unit", threshold=None).count() == 0
    assert got[1].thin and got[1].recent_rank == (35 + 38) / 2
    hist, got = signals(spark, {1: {t: 5 + 3 * t for t in range(15)}})
    assert got[1].slope == pytest.approx(3) and not got[1].thin
    assert temporal.rank_trend(hist, "unit").first().slope == pytest.approx(3)


def test_one_baseline_for_all_units(spark):
    # Unit 2 misses frames 5 to 14: its last five ranks lie after the archive's ten baseline frames.
    gappy = {t: 10 for t in range(5)} | {t: 10 + 4 * (t - 14) for t in range(15, 20)}
    hist, got = signals(spark, {1: {t: 50 for t in range(20)}, 2: gappy, 3: {t: 7 for t in range(11)}, 4: {t: 9 for t in range(12, 20)}})
    assert (got[2].n_recent, got[2].base_rank, got[2].recent_rank, got[2].slope) == (5, 10, 22, pytest.approx(4))
    assert got[2].drop == pytest.approx((22 - 10) / 5)
    assert 3 not in got, "one rank after the baseline is no history"
    assert got[4].drop is None and got[4].slope == pytest.approx(0), "no baseline, no drop"
    assert {r.unit: r.n_base for r in temporal.rank_baseline(hist, "unit").collect()} == {1: 10, 2: 10, 3: 10}
    matrix = temporal.rank_rows(hist, "unit").where("unit = 2").collect()
    assert [r["rank"] for r in sorted(matrix, key=lambda r: r.frame_idx)] == [10] * 5 + [14, 18, 22, 26, 30] and {r.median_rank for r in matrix} == {12.0}


def plain_neighbours(sizes):
    at = [(r, c) for r, n in enumerate(sizes) for c in range(n)]
    name, out = {p: i for i, p in enumerate(at)}, set()
    for r, c in at:
        near = [(r, c - 1), (r, c + 1)]
        for q in (r - 1, r + 1):
            if 0 <= q < len(sizes):
                d = sizes[q] - sizes[r]
                near += [(q, c + k) for k in ((0, 1) if d > 0 else (-1, 0) if d < 0 else (-1, 0, 1))]
        out |= {(name[r, c], name[p]) for p in near if p in name}
    return out


def test_neighbours_of_equal_rows(spark):
    for sizes in ([3, 3], [2, 3, 3, 2], ROW_SIZES):
        got = {tuple(r) for r in geometry.hex_edges(geometry.row_table(spark, sizes)).collect()}
        assert got == plain_neighbours(sizes)
    three = geometry.neighbour_count(geometry.hex_edges(geometry.row_table(spark, [3, 3])))
    assert {r.mirror_id: r.n_neighbours for r in three.collect()} == {0: 3, 1: 5, 2: 3, 3: 3, 4: 5, 5: 3}


def test_pairs_by_part_and_grids_by_block(spark, monkeypatch):
    frames = spark.createDataFrame([(f"2024-{m:02d}-{d:02d}", u) for m in (1, 3, 4) for d in (1, 2, 9) for u in range(5) if (m + d + u) % 4], "frame string, unit int")
    want = {tuple(r) for r in score.consecutive_pairs(frames, "frame").collect()}
    assert {tuple(r) for r in score.consecutive_pairs(frames, "frame", F.substring("frame", 1, 7)).collect()} == want and len(want) == 8
    whole = {tuple(r) for r in selection.missing_cells(frames, frames, frames, "frame", "unit").collect()}
    monkeypatch.setattr(selection, "BLOCK_UNITS", 2)
    assert {tuple(r) for r in selection.missing_cells(frames, frames, frames, "frame", "unit").collect()} == whole and whole


def test_clusters_equal_plain_dbscan(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, [float(v) for v in rng.normal(0, 1, 3) + 4 * rng.integers(0, 3)]) for g in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "unit int, frame int, x array<double>")
    for eps, least in ((0.7, 3), (0.5, 2), (1.0, 1), (0.9, 6)):
        got = {(r.unit, r.frame): r.cluster for r in ml.dbscan(df, "unit", ["frame"], "x", eps, least).collect()}
        for g in range(3):
            want = ml.dbscan_labels(np.array([x for u, _, x in rows if u == g]), eps, least)
            assert [got[g, i] for i in range(120)] == want.tolist()
    noise = {(r.unit, r.frame) for r in ml.neighbour_noise(df, "unit", "frame", "x", 0.5).collect()}
    assert noise == {(r.unit, r.frame) for r in ml.noise(ml.dbscan(df, "unit", ["frame"], "x", 0.5, 2)).collect()}


def test_metric_blocks_spare_distances_and_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 20, (30, 16))
    x = np.concatenate([c + rng.normal(0, 0.3, (60, 16)) for c in centres])
    points = spark.createDataFrame([(1, i, [float(v) for v in p]) for i, p in enumerate(x)], "group int, id long, x array<double>")
    want = (((x[:, None] - x[None]) ** 2).sum(axis=2) <= 1.5**2).sum(axis=1) - 1
    for size in (4096, 25):
        rows, blocks = nearness.blocked(points, block_rows=size)
        assert rows.groupBy("block").count().agg(F.max("count")).first()[0] <= max(200, 3 * size)
        found = {r.id: r for r in nearness.neighbour_counts(rows, nearness.block_pairs(blocks, 1.5), blocks, 1.5).collect()}
        assert {i: r.n for i, r in found.items() if r.n} == {i: n for i, n in enumerate(want) if n}
        # A tenth of all pairs at most is measured, though no element alone tells the clusters apart.
        assert sum(r.measured for r in found.values()) < len(x) ** 2 / 10
        links = nearness.core_links(rows, nearness.block_pairs(blocks, 1.5), blocks, 1.5)
        assert links.count() < sum(want) / 4  # a few for each row, not all pairs


def test_rows_are_sent_once_for_each_part(spark):
    """Rows that are all about equally far apart meet all blocks, but are sent only to a few pairs of parts."""
    x = np.random.default_rng(7).normal(size=(3000, 8))
    points = spark.createDataFrame([(1, i, [float(v) for v in p]) for i, p in enumerate(x)], "group int, id long, x array<double>")
    rows, blocks = nearness.blocked(points, block_rows=20)
    pairs = nearness.block_pairs(blocks, 2.0)
    assert blocks.count() > 60 and pairs.count() > 1500
    assert sum(side.count() for side in nearness._sides(rows, pairs, [])) <= (nearness.MOST_PARTS + 1) * len(x)
    want = (((x[:, None] - x[None]) ** 2).sum(axis=2) <= 4.0).sum(axis=1) - 1
    found = {r.id: r.n for r in nearness.neighbour_counts(rows, pairs, blocks, 2.0).where("n > 0").collect()}
    assert found == {i: n for i, n in enumerate(want) if n}


def test_dbscan_of_odd_rows(spark):
    rows = [(1, 1, [0.0, 0.0]), (1, 1, [0.0, 0.0]), (1, 2, None), (1, 3, [0.0, None]), (None, 4, [0.0, 0.0]), (2, 5, [float("nan"), 0.0]), (2, 6, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "unit int, frame int, x array<double>")
    got = sorted(((r.unit or 0, r.frame, r.cluster) for r in ml.dbscan(df, "unit", ["frame"], "x", 0.5, 2).collect()), key=repr)
    assert got == sorted([(1, 1, 0), (1, 1, 0), (1, 2, None), (1, 3, None), (0, 4, -1), (2, 5, None), (2, 6, -1)], key=repr)
    assert ml.dbscan(df.limit(0), "unit", ["frame"], "x", 0.5, 2).collect() == []


def test_forest_in_parts(spark):
    rng = np.random.default_rng(0)
    rows = [(1, i, *map(float, v)) for i, v in enumerate(np.concatenate([rng.normal(0, 1, (400, 2)), [[9.0, 9.0]]]))] + [(None, 0, 1.0, 1.0), (2, 1, None, 2.0)]
    df = spark.createDataFrame(rows, "unit int, frame int, a double, b double")
    whole = {(r.unit, r.frame): r.score for r in ml.isolation_forest(df, "unit", ["frame"], ["a", "b"], trees=20).collect()}
    parts = {(r.unit, r.frame): r.score for r in ml.isolation_forest(df, "unit", ["frame"], ["a", "b"], trees=20, part_rows=50).collect()}
    assert parts == pytest.approx(whole) and len(whole) == 402
    assert max((k for k in whole if k[0] == 1), key=whole.get) == (1, 400)


def test_kmeans_rows_go_to_the_nearest_centre(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows, centres = ml.kmeans(df, "embedding", 10)
    got = rows.select("embedding", "cluster").collect()
    d = ((np.array([r.embedding for r in got], float)[:, None] - centres[None]) ** 2).sum(axis=2)
    assert np.allclose(d[np.arange(len(got)), [r.cluster for r in got]], d.min(axis=1), atol=1e-6)
    sizes = {r.cluster: r.n for r in ml.cluster_sizes(rows).collect()}
    assert sizes == {k: int(n) for k, n in enumerate(np.bincount([r.cluster for r in got])) if n}
