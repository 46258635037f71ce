"""Scoring of new observations as they arrive, against stored baselines.

The joins are stateless: a stream of observations meets a static baseline, so
neither watermark nor state is needed, and every batch can be retried alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwatch.operators import score


def observation_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of observations as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def outlier_stream(obs: DataFrame, baseline: DataFrame, frame: str, unit: str, features: list[str], threshold: float = 3.0) -> DataFrame:
    """High and low features of each new observation."""
    return score.feature_outliers(score.z_scores(obs, baseline, frame, unit, features), threshold)


def distance_stream(obs: DataFrame, vbaseline: DataFrame, unit: str, features: list[str], cut: float) -> DataFrame:
    """New observations whose distance to their facet's baseline is above a fixed cut."""
    return score.mahalanobis(obs, vbaseline, unit, features).where(F.col("mahalanobis") > cut)


def append_to(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Starts the append of a stream to a Parquet table."""
    out = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
