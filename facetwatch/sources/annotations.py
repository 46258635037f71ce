"""Hand annotations: which facets are marked in which frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwatch.functions.times import int_list
from facetwatch.schemas import ANNOTATIONS


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``file, mirror_id`` from a JSON list of files and their marked facets."""
    rows = spark.read.schema(ANNOTATIONS).json(path, multiLine=True)
    return rows.select("file", F.explode("marked_mirrors").alias("mirror_id")).distinct()


def from_text(rows: DataFrame, file: str, marks: str) -> DataFrame:
    """``file, mirror_id`` from comma lists."""
    return rows.select(F.col(file).alias("file"), F.explode(int_list(marks)).alias("mirror_id")).distinct()


def annotation_lists(annotations: DataFrame) -> DataFrame:
    """``file, marked_mirrors`` sorted; a frame has a few hundred facets at most."""
    return annotations.groupBy("file").agg(F.sort_array(F.collect_set("mirror_id")).alias("marked_mirrors"))


def write_annotations(annotations: DataFrame, path: str) -> None:
    annotation_lists(annotations).write.mode("overwrite").json(path)
