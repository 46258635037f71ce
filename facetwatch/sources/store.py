"""Stored tables: observations, baselines, crops, ranks, and what they contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_observations(obs: DataFrame, path: str, ts: str = "ts", meta: dict[str, str] | None = None, frame: str = "frame_id", unit: str = "mirror_id") -> None:
    """Observations by day, and a one-row table of metadata beside them."""
    obs.withColumn("date", F.to_date(ts)).write.mode("overwrite").partitionBy("date").parquet(f"{path}/observations")
    facts = obs.agg(F.countDistinct(frame).alias("n_images"), F.countDistinct(unit).alias("n_mirrors"), F.current_timestamp().alias("created_at"))
    for k, v in (meta or {}).items():
        facts = facts.withColumn(k, F.lit(v))
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Observations and metadata."""
    return spark.read.parquet(f"{path}/observations"), spark.read.parquet(f"{path}/meta")


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A baseline, a list of scores or of ranks."""
    out = df.write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).parquet(path)


def write_crops(crops: DataFrame, path: str) -> None:
    """Crops by facet: one shuffle, so that each facet's files are few."""
    crops.repartition("mirror_id").write.mode("overwrite").partitionBy("mirror_id").parquet(path)


def crop_info(crops: DataFrame) -> DataFrame:
    """Observations per facet, and in all (``mirror_id`` NULL)."""
    return crops.rollup("mirror_id").agg(F.count("*").alias("n_observations"), F.countDistinct("frame_id").alias("n_frames"))


def crop_manifest(crops: DataFrame) -> DataFrame:
    """Which frame each entry of a facet comes from, in time order."""
    from pyspark.sql import Window

    w = Window.partitionBy("mirror_id").orderBy("ts", "frame_id")
    return crops.select("mirror_id", (F.row_number().over(w) - 1).alias("entry"), "frame_id", "ts")


def rank_lists(ranks: DataFrame, ts: str, unit: str, value: str) -> DataFrame:
    """One row per time with all facets' values in facet order: ``ranks`` is an array of (unit, value); a frame has a few hundred facets."""
    return ranks.groupBy(ts).agg(F.sort_array(F.collect_list(F.struct(unit, value))).alias("ranks"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_table`` stored."""
    return spark.read.parquet(path)


def rank_table(ranks: DataFrame, ts: str, unit: str, value: str, units: list) -> DataFrame:
    """One row per time, one column per facet."""
    return ranks.groupBy(ts).pivot(unit, units).agg(F.first(value)).orderBy(ts)
