"""Detection quality against annotations: counts, precision, recall, F1, IoU, AP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.operators.ranks import ranked


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, F1 and IoU to ``tp, fp, fn``."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", _ratio(2 * p * r, p + r)).withColumn("iou", _ratio(tp, tp + fp + fn))


def detection_metrics(predicted: DataFrame, truth: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Metrics of a predicted set of rows against the true one, per ``by`` or in all.

    ``keys`` identify a row, ``by`` is a part of the keys or empty. Repeated
    rows count once. Without ``by`` one row comes back for empty inputs too.
    """
    by = by or []
    both = predicted.select(*keys).distinct().withColumn("_p", F.lit(1)).join(truth.select(*keys).distinct().withColumn("_t", F.lit(1)), keys, "full_outer")
    p, t = F.col("_p").isNotNull(), F.col("_t").isNotNull()
    return with_rates(both.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn")))


def micro_metrics(predicted: DataFrame, truth: DataFrame, existing: DataFrame, frame: str, unit: str) -> DataFrame:
    """Totals over the annotated frames that exist."""
    annotated = truth.select(frame).distinct().join(existing.select(frame), frame, "left_semi")
    return detection_metrics(predicted.join(annotated, frame, "left_semi"), truth.join(annotated, frame, "left_semi"), [frame, unit])


def average_precision(scored: DataFrame, truth: DataFrame, keys: list[str], score: str, by: list[str]) -> DataFrame:
    """Area under the precision-recall steps of a ranking, per ``by``.

    Ties in the score are broken by the other keys. ``n_truth`` counts all true
    rows, also those without a score. Rows are ranked in ranges of scores, so a
    group may be of any size.
    """
    rows = scored.select(*keys, score).where(F.col(score).isNotNull()).join(truth.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    rest = [F.col(k) for k in keys if k not in by]
    rows = ranked(rows.withColumn("_hit", F.coalesce("_hit", F.lit(0))), by, [F.desc(score), *rest], {"_cum": F.col("_hit")})
    area = rows.groupBy(*by).agg(F.sum(F.col("_hit") * F.col("_cum") / F.col("_pos")).alias("_area"))
    n = truth.select(*keys).distinct().groupBy(*by).agg(F.count("*").alias("n_truth"))
    return n.join(area, by, "left").select(*by, "n_truth", _ratio(F.coalesce("_area", F.lit(0.0)), F.col("n_truth")).alias("ap"))


def recall_at_k(scored: DataFrame, truth: DataFrame, keys: list[str], score: str, by: list[str], k: int) -> DataFrame:
    """Share of the true rows among the first k of a ranking, per ``by``."""
    first = top_suspects(scored.select(*keys, score), by, [x for x in keys if x not in by], score, k)
    hits = truth.select(*keys).distinct().join(first.select(*keys, F.lit(1).alias("_in")), keys, "left")
    return hits.groupBy(*by).agg(F.count("*").alias("n_truth"), F.count("_in").alias("n_found"), F.avg(F.coalesce("_in", F.lit(0))).alias("recall"))


def detector_metrics(outliers: DataFrame, truth: DataFrame, keys: list[str], detector: str = "feature") -> DataFrame:
    """Metrics of each detector (feature or strategy) against the same truth."""
    found = outliers.select(detector, *keys).distinct()
    hits = found.join(truth.select(*keys).distinct().withColumn("_t", F.lit(1)), keys, "left")
    per = hits.groupBy(detector).agg(F.count("_t").alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"))
    total = truth.select(*keys).distinct().agg(F.count("*").alias("_all"))
    return with_rates(per.join(F.broadcast(total)).select(detector, "tp", "fp", (F.col("_all") - F.col("tp")).alias("fn")))


def top_suspects(scored: DataFrame, by: list[str], ties: list[str], score: str, n: int) -> DataFrame:
    """The n rows with the largest score per ``by``; ties go to the smaller ``ties``."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), *ties)
    return scored.where(F.col(score).isNotNull()).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
