"""Hard negatives against brute force, the walk's pruning, and odd rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetwatch.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=50, scale=256, positives=5, few=3, low=50, high=95):
    """Counter of result rows; rows are (id, label, vector)."""
    fit = [(i, y, [int(np.floor(scale * c)) for c in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = Counter()
    for i, y, v in {(i, y, tuple(v)) for i, y, v in fit if i % every == 0}:
        others = sorted(((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in fit if j != i and len(w) == len(v)), key=lambda t: t[:2])
        for ps, p, _ in [t for t in others if t[2] == y][:positives]:
            band = [(-s, j) for s, j, z in others if z != y and low * -ps <= 100 * -s <= high * -ps]
            out.update((i, p, k + 1, j, -ps, s) for k, (s, j) in enumerate(band[:few]))
    return out


def found(df, **options):
    rows = negatives.hard_negatives(df, F.col("id") % 50 == 0, **options).collect()
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows)


def random_rows(n, dims, labels, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    return [(int(i), int(rng.integers(labels)), list(map(float, centres[rng.integers(8)] + spread * rng.normal(size=dims)))) for i in range(n)]


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_equals_brute_force(spark, spread):
    rows = random_rows(900, 6, 4, 1, spread)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert found(df) == want and sum(want.values()) > 40
    # Small blocks, split teams and many clusters change how far lists are walked, not what is found.
    assert found(df, block_rows=70, group_rows=5, cluster_rows=2) == want


def test_ties_repeats_and_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [float(x) / 4 for x in rng.integers(-2, 3, 3)]) for i in range(300)]  # few values: ties everywhere
    rows += [rows[0], rows[50], rows[51], rows[51], (50, 1, [0.5, 0.5, 0.5]), (100, 2, [0.25, 0.25, 0.0, 1.0]), (101, 2, [1.0, 0.0, 0.0, 1.0]), (102, 1, [0.5, 0.25, 0.0, 0.5]), (150, 0, [0.0, 0.0, 0.0]), (200, 1, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute(rows)
    assert found(df, block_rows=40, group_rows=2, cluster_rows=1) == brute(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = random_rows(120, 4, 2, 5)
    odd = [(None, 1, [1.0] * 4), (300, None, [1.0] * 4), (350, 1, None), (400, 1, [1.0, None, 0.0, 0.0]), (450, 1, [nan, 0.0, 0.0, 0.0]), (500, 0, [inf, 0.0, 0.0, 0.0]), (550, 7, [0.5] * 4)]
    df = spark.createDataFrame(good + odd, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("id", "x", "dims", "copies", "team", "block", "score", "rank", "variant")))
    assert found(df) == brute(good + odd)
    assert found(spark.createDataFrame([], SCHEMA)) == Counter()
    assert found(spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0])], SCHEMA)) == Counter()  # no anchor


def test_large_values_stay_exact(spark):
    rows = [(i, i % 2, [float((i * 7919) % 1000 + 2**26), float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, scale=1.0) == brute(rows, scale=1)
    with pytest.raises(Exception, match="64 bits"):
        found(spark.createDataFrame([(0, 0, [2.0**40]), (1, 0, [2.0**40])], SCHEMA), scale=1.0)


def test_bounds_hold_and_walks_end_early():
    rng = np.random.default_rng(2)
    x = np.rint(rng.normal(size=(4000, 8)) * 100).astype(float)
    members = np.rint(100 * np.ones((20, 8)) + rng.normal(size=(20, 8)) * 2)
    block = negatives.Block(x)
    most = negatives.bounds(members, block.unit, block.size)
    assert (members @ x.T <= np.linalg.norm(members, axis=1)[:, None] * most[None] + 1e-6).all()
    best = negatives.Best(20, 5)
    ones = np.ones(len(x), np.int64)

    def take(active, places, scores):
        m, j = np.nonzero(scores >= best.worst[active, None])
        best.add(active[m], scores[m, j], places[j], ones[places[j]])

    taken = negatives.walk(members, block, np.arange(len(x)), take, lambda active, most: best.worst[active] > most, first=64)
    assert taken < 20 * len(x) / 4
    want = np.sort(members @ x.T, axis=1)[:, ::-1][:, :5]
    assert (best.score == want).all()


def test_no_cross_join_and_bounded_output(spark):
    df = spark.createDataFrame(random_rows(500, 4, 3, 9), SCHEMA)
    plan = negatives.hard_negatives(df, F.col("id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
