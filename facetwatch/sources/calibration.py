"""Calibration files: facet polygons, and how they are made from a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwatch.functions.times import mirror_key, mirror_of
from facetwatch.operators.geometry import grid_cells, grid_map
from facetwatch.schemas import CALIBRATION


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """``mirror_id, points`` (array of x, y) of a calibration file."""
    rows = spark.read.schema(CALIBRATION).json(path, multiLine=True).select(F.explode("mirror_ids").alias("key", "p"))
    return rows.select(mirror_of("key").alias("mirror_id"), F.transform("p", lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))).alias("points"))


def require_facets(facets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Polygons of the wanted facets; one that is not calibrated raises when it is met."""
    both = wanted.select("mirror_id").distinct().join(facets, "mirror_id", "left")
    missing = F.raise_error(F.concat(F.lit("no polygon for "), mirror_key("mirror_id"))).cast(facets.schema["points"].dataType)
    return both.withColumn("points", F.coalesce("points", missing))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``row, grid_id_start, grid_id_stop`` of a text file with one row of facets per line."""
    return spark.read.csv(path, header=True, schema="row int, grid_id_start int, grid_id_stop int", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def make_calibration(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """``mirror_id, points`` from ranges of grid cells and the grid's crossing points."""
    cells = grid_cells(points).select("grid_id", "points")
    return grid_map(ranges).join(cells, "grid_id").select("mirror_id", "points")


def calibration_document(facets: DataFrame, image: str) -> DataFrame:
    """One row in the shape of a calibration file. A dish has a few hundred facets."""
    pair = F.struct(mirror_key("mirror_id").alias("key"), F.transform("points", lambda p: F.array(p["x"], p["y"])).alias("value"))
    return facets.agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("mirror_ids")).select(F.lit(image).alias("calib_img"), "mirror_ids")


def write_calibration(facets: DataFrame, image: str, path: str) -> None:
    calibration_document(facets, image).coalesce(1).write.mode("overwrite").json(path)
