"""Whitening against NumPy over plain lists, and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetwatch.llm import whitening
from facetwatch.llm.registry import op13_whitening
from oracle import DATA

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, components=8, weights="counts"):
    """(n, deviation by row, eigenvalues, axes, x - mean by row)"""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    fit = x if weights == "counts" else sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    far = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    own = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    return n, far, values[::-1][:components], axes[:, ::-1][:, :components], own, values.sum()


def check(out, rows, **options):
    n, far, values, axes, own, trace = brute(rows, **options)
    got = {}
    for r in out.collect():
        got.setdefault(r.component, []).append(r)
    assert len(got) == len(values) and all(len(v) == len(rows) for v in got.values())
    for k, (e, axis) in enumerate(zip(values, axes.T), 1):
        part = sorted(got[k], key=lambda r: (r.vec_id, int(r.deviation), r.whitened))
        assert {r.n for r in part} == {n} and max(r.identity_error for r in part) < 1e-4 and np.allclose([r.explained for r in part], e / trace, rtol=1e-4)
        want = own @ axis / math.sqrt(e)
        sign = np.sign(sum(r.whitened * w for r, w in zip(part, [w for _, _, w in sorted((rows[i][0], far[i], want[i]) for i in range(len(rows)))])))
        ours = sorted((r.vec_id, int(r.deviation), round(sign * r.whitened, 6) + 0.0) for r in part)
        assert ours == sorted((rows[i][0], far[i], round(w, 6) + 0.0) for i, w in enumerate(want))


def test_table_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check(op13_whitening(spark, DATA), rows)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_copies_weigh_as_asked(spark, weights):
    rng = np.random.default_rng(1)
    rows = [(i, list(map(float, rng.normal(size=5) * [5, 4, 3, 2, 1]))) for i in range(80)]
    rows += [(100 + i, rows[3][1]) for i in range(60)] + [rows[5]]  # a vector that many rows share, and a row twice
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("x", "_h", "n", "component", "z", "k")))
    check(whitening.whiten(df, weights=weights), rows, components=5, weights=weights)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (None, [3.0, 1.0]), (3, [0.0, -1.0]), (3, [2.0, 2.5])]
    odd = [(4, None), (5, [1.0, None]), (6, [nan, 0.0]), (7, [-inf, 0.0]), (8, [1.0]), (9, [])]
    out = whitening.whiten(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == sorted((i or 0, k) for i, _ in rows for k in (1, 2))
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    for df in (one, spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None), (2, [])], SCHEMA)):
        none = whitening.whiten(df)
        assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and none.collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(one, max_dims=1)


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 1.0, 2.0 * i]) for i in range(20)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-4


def test_deviation_is_exact_beyond_64_bits(spark):
    rows = [(i, [float(i % 7) * 1e9, float(i)]) for i in range(50)]
    n, far, *_ = brute(rows)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA), components=1).collect()}
    assert got == {i: far[i] for i in range(50)} and max(far) > 1 << 63
