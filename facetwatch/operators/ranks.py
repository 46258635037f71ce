"""Ranks within groups of any size: rows are dealt out by range, and parts are put in order by their counts.

No window holds a group: a part holds one range of values, and what comes before it is the
sum over the parts before. The dealt rows are settled first, since a range's ends are sampled
and would not come out alike twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.operators.lineage import cut


def dealt(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_part``; and for each group and part ``_before`` and ``_here`` rows, with the same of each of ``sums`` (``<name>_before``)."""
    sums = sums or {}
    spread = [F.col(c) for c in by] + order
    rows = cut(rows.repartitionByRange(*spread).withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_here"), *(F.sum(c).alias(n) for n, c in sums.items()))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_here").over(earlier), F.lit(0))} | {f"{n}_before": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in sums})
    return rows, parts.drop(*sums)


def ranked(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None, rank: str = "_pos") -> DataFrame:
    """``rows`` with their rank from 1 in their group, and the running sum of each of ``sums`` up to and with the row."""
    sums = sums or {}
    rows, parts = dealt(rows, by, order, sums)
    w = Window.partitionBy(*by, "_part").orderBy(*order)
    rows = rows.withColumns({rank: F.row_number().over(w)} | {n: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()})
    out = rows.join(parts, [*by, "_part"])
    return out.withColumns({rank: F.col(rank) + F.col("_before")} | {n: F.col(n) + F.col(f"{n}_before") for n in sums}).drop("_part", "_before", "_here", *(f"{n}_before" for n in sums))


def percentiles(rows: DataFrame, value: str, at: list[float], by: list[str]) -> DataFrame:
    """``by, percentile, value``: exact, interpolated percentiles; only the parts that hold a wanted rank are ordered."""
    rows = rows.select(*by, value).where(F.col(value).isNotNull())
    rows, parts = dealt(rows, by, [F.col(value)])
    totals = parts.groupBy(*by).agg(F.sum("_here").alias("_n"))
    wanted = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("p"), ((F.col("_n") - 1) * F.lit(float(p))).alias("x")) for p in at)))
    places = totals.select(*by, wanted.alias("w")).select(*by, F.col("w.p").alias("percentile"), F.col("w.x").alias("_x"))
    places = places.withColumn("_place", F.explode(F.array_distinct(F.array(F.floor("_x"), F.ceil("_x")))))
    places = places.join(parts, by) if by else places.join(F.broadcast(parts))
    places = cut(places.where((F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_here"))).select(*by, "_part", "percentile", "_x", (F.col("_place") - F.col("_before") + 1).alias("_k"), "_place"))
    near = rows.join(places.select(*by, "_part").distinct(), [*by, "_part"], "left_semi")
    near = near.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(value)))
    found = places.join(near, [*by, "_part", "_k"])
    share = 1 - F.abs(F.col("_x") - F.col("_place"))
    return found.groupBy(*by, "percentile").agg(F.sum(F.col(value) * share).alias("value"))
