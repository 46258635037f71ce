"""Whitening of embeddings by a weighted covariance of distinct vectors.

Components become whole numbers (``floor(scale * c) + shift``), so that equal
vectors can be grouped exactly. Distinct vectors are written once with how often
they occur; the fit weighs each by that count, or by one. Sums are exact, the
covariance is a weighted product of centred blocks, and each distinct vector is
projected once; rows get their vector's numbers by a join back.

Scale. The distinct table is made with map-side combining, so copies of one
vector never move as rows. Products run over Arrow batches where the table lies;
a task gives off one ``dims x dims`` block, blocks are added by a grouped sum,
and only the sum, bounded by ``max_dims`` squared numbers, comes to the driver
for its eigenvectors. In the join back, vectors that make up more than a
thousandth of the rows (so fewer than a thousand of them, whatever the size)
are broadcast, and the others meet in a shuffled join by hash and vector: a vector
that a third of all rows share stays spread over the tasks that read it.

Defined cases: rows whose vector is null, or holds null or non-finite entries,
take no part; vectors of another length than the most frequent one (of ties, the
longest) take no part either; rows that repeat an id or vector each get their
numbers; null ids stay; a component without variance (eigenvalue below 1e-12 of
the trace) cannot be whitened and is left out, so one row, or equal rows, give
no result; an empty table gives an empty result; other columns are ignored;
``deviation`` beyond a long is an error under ANSI mode, as any cast is.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwatch.llm.common import scratch

SCHEMA = "x array<long>, _h long, _c long, _w long, deviation decimal(38,0), z array<double>"


def whole_vectors(rows: DataFrame, vector_col: str, scale: float = 1024, shift: int = 100_000) -> DataFrame:
    """Rows with ``x``, their vector in whole numbers; rows without a finite vector go."""
    bad = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = rows.where(F.col(vector_col).isNotNull() & ~bad)
    return rows.withColumn("x", F.transform(vector_col, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long")))


def _matrix(b: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def covariance(rows: DataFrame, column: str, mean: np.ndarray, total: int) -> np.ndarray:
    """Covariance of a column of vectors with weights ``_w``, divisor ``total``.

    Vectors are centred about ``mean`` before they are multiplied; what rounding left
    of their mean is summed beside and taken off.
    """
    size = len(mean)

    def part(batches: Iterator[pa.RecordBatch]):
        product, sums = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            z, w = _matrix(b, column, size) - mean, b.column("_w").to_numpy().astype(float)
            product += z.T @ (z * w[:, None])
            sums += w @ z
        i, j = np.indices((size + 1, size), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(np.vstack([product, sums]).ravel())], ["i", "j", "v"])

    cells = rows.select(column, "_w").mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((size + 1, size))
    out[cells.i, cells.j] = cells.v
    rest = out[size] / total
    return out[:size] / total - np.outer(rest, rest)


def _whitened(sums: list[int], n: int, project: np.ndarray):
    """Arrow batches of distinct vectors with their exact deviation and projection."""
    dims, mean, exact = len(sums), np.array([s / n for s in sums]), np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = _matrix(b, "x", dims)
            if len(x) and int(np.abs(x).max()) * n + max(map(abs, sums)) < 1 << 62:
                d = x * n - exact.astype(np.int64)
            else:
                d = x.astype(object) * n - exact
            if len(x) and int(np.abs(d).max()) ** 2 * dims >= 1 << 62:
                d = d.astype(object)
            far = pa.array([decimal.Decimal(int(v)) for v in (d * d).sum(axis=1)], pa.decimal128(38, 0))
            z = pa.array(list((x - mean) @ project), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("x", "_h", "_c", "_w")), far, z], ["x", "_h", "_c", "_w", "deviation", "z"])

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, weights: str = "counts", scale: float = 1024, shift: int = 100_000, max_dims: int = 4096) -> DataFrame:
    """Whitened components of each row, from 1 by falling eigenvalue.

    ``id, component, n, deviation, whitened, explained, identity_error``.
    ``weights``: ``counts`` fits over all rows, ``one`` over distinct vectors; ``n`` is the
    sum of the weights. ``deviation`` is the exact sum over dimensions of ``(n x - S)^2``
    with ``S`` the weighted sums; ``identity_error`` is measured on the whitened vectors.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights: counts or one")
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], f"{id_col} {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    vectors = whole_vectors(rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")), "_v", scale, shift).select("_id", "x", F.xxhash64("x").alias("_h"))

    groups, done = scratch(spark, "whitening-groups"), scratch(spark, "whitening-done")
    counted = vectors.groupBy("x", "_h").agg(F.count("*").alias("_c"))
    counted.withColumn("_w", F.col("_c") if weights == "counts" else F.lit(1).cast("long")).write.parquet(groups)
    distinct = spark.read.parquet(groups)
    top = distinct.where(F.size("x") > 0).groupBy(F.size("x").alias("k")).agg(F.sum("_c").alias("c"), F.sum("_w").alias("n")).orderBy(F.desc("c"), F.desc("k")).first()
    if top is None:
        return nothing
    dims, n = top.k, top.n
    if dims > max_dims:
        raise ValueError(f"{dims} dimensions; max_dims is {max_dims}")
    distinct = distinct.where(F.size("x") == dims)
    found = distinct.select("_w", F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(20,0)") * F.col("_w").cast("decimal(18,0)")).alias("s")).collect()
    sums = [int(r.s) for r in sorted(found, key=lambda r: r.d)]
    values, axes = np.linalg.eigh(covariance(distinct, "x", np.array([s / n for s in sums]), n))
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(values.sum())
    kept = [k for k in range(min(components, dims)) if values[k] > 1e-12 * trace > 0]
    if not kept:
        return nothing
    distinct.mapInArrow(_whitened(sums, n, axes[:, kept] / np.sqrt(values[kept])), SCHEMA).write.parquet(done)
    table = spark.read.parquet(done)
    error = float(np.abs(covariance(table, "z", np.zeros(len(kept)), n) - np.eye(len(kept))).max())

    # Fewer than a thousand vectors can each make up more than a thousandth of the rows.
    often = F.broadcast(table.where(F.col("_c") * 1000 > top.c).select("x", "_h", "deviation", "z"))
    rest = table.where(F.col("_c") * 1000 <= top.c).select("x", "_h", "deviation", "z")
    both = vectors.join(often, ["_h", "x"]).unionByName(vectors.join(often, ["_h", "x"], "left_anti").join(rest, ["_h", "x"]))
    shares = F.array(*(F.lit(float(values[k] / trace)) for k in kept))
    out = both.select("_id", "deviation", F.posexplode("z").alias("k", "whitened"))
    return out.select(F.col("_id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))
