"""Facet positions, neighbours and the map from grid cells to facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetwatch.schemas import ROW_SIZES


def row_table(spark: SparkSession, row_sizes: list[int] = ROW_SIZES) -> DataFrame:
    """``row, size, first``: facets per row, and the id of the row's first facet."""
    first = [sum(row_sizes[:r]) for r in range(len(row_sizes))]
    return spark.createDataFrame([(r, n, f) for r, (n, f) in enumerate(zip(row_sizes, first, strict=True))], "row int, size int, first int")


def row_table_of(rows: DataFrame, row: str, size: str) -> DataFrame:
    """The same from a table of row sizes; the running sum is over the few rows of a dish."""
    w = Window.partitionBy(F.lit(0)).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(F.col(row).cast("int").alias("row"), F.col(size).cast("int").alias("size"), F.coalesce(F.sum(size).over(w), F.lit(0)).cast("int").alias("first"))


def hex_positions(rows: DataFrame) -> DataFrame:
    """``mirror_id, row, col, x, y``: rows are centred, and sqrt(3)/2 apart."""
    cells = rows.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("col"))
    return cells.select((F.col("first") + F.col("col")).alias("mirror_id"), "row", "col", (F.col("col") - (F.col("size") - 1) / 2).alias("x"), (F.col("row") * F.sqrt(F.lit(3.0)) / 2).alias("y"))


def hex_edges(rows: DataFrame, touching: bool = False) -> DataFrame:
    """Directed neighbour edges ``a, b`` (both ways, without repeats).

    Within a row the facets left and right; in the next row columns c, c + 1 of a
    wider row, c - 1, c of a narrower one, and c - 1, c, c + 1 of an equal one.
    ``touching`` takes only c, c + 1 of an equal row, so that no facet has more than
    six neighbours.
    """
    cells = rows.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("col"))
    here = cells.select("row", "size", "col", (F.col("first") + F.col("col")).alias("a"))
    beside = here.where("col + 1 < size").select("a", (F.col("a") + 1).alias("b"))
    below = rows.select((F.col("row") - 1).alias("row"), F.col("size").alias("_size"), F.col("first").alias("_first"))
    equal = [0, 1] if touching else [-1, 0, 1]
    step = F.when(F.col("_size") < F.col("size"), F.array(F.lit(-1), F.lit(0))).when(F.col("_size") > F.col("size"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(*map(F.lit, equal)))
    down = here.join(below, "row").select("a", "_size", "_first", F.explode(F.transform(step, lambda s: F.col("col") + s)).alias("_col"))
    down = down.where("_col >= 0 and _col < _size").select("a", (F.col("_first") + F.col("_col")).alias("b"))
    one = beside.unionByName(down)
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, smaller id first."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def neighbour_count(edges: DataFrame) -> DataFrame:
    """``mirror_id, n_neighbours``."""
    return edges.select("a", "b").distinct().groupBy(F.col("a").alias("mirror_id")).agg(F.count("*").alias("n_neighbours"))


def grid_cells(points: DataFrame, width: int = 18) -> DataFrame:
    """Cells of a grid of crossing points ``i, j, x, y``: a closed polygon of four corners each.

    A cell is an equality join of its corners; ``grid_id`` counts row by row.
    """
    p = points.select("i", "j", F.struct("x", "y").alias("p"))

    def corner(di: int, dj: int, name: str) -> DataFrame:
        return p.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("p").alias(name))

    cells = corner(0, 0, "a").join(corner(0, 1, "b"), ["i", "j"]).join(corner(1, 1, "c"), ["i", "j"]).join(corner(1, 0, "d"), ["i", "j"])
    return cells.select((F.col("i") * (width - 1) + F.col("j")).alias("grid_id"), "i", "j", F.array("a", "b", "c", "d", "a").alias("points"))


def grid_points(flat: DataFrame, points: str, width: int = 18) -> DataFrame:
    """``i, j, x, y`` from one array of [x, y] points in row order."""
    rows = flat.select(F.posexplode(points).alias("k", "p"))
    return rows.select(F.floor(F.col("k") / width).cast("int").alias("i"), (F.col("k") % width).alias("j"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def grid_map(ranges: DataFrame) -> DataFrame:
    """``mirror_id, row, grid_id`` from inclusive ranges ``row, grid_id_start, grid_id_stop``; facets are numbered in order.

    Ranges of a row must not overlap. Only the ranges, one for each row of the dish, are put in
    order; their cells are numbered from what comes before.
    """
    n = F.col("grid_id_stop") - F.col("grid_id_start") + 1
    w = Window.partitionBy(F.lit(0)).orderBy("row", "grid_id_start").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.where("grid_id_stop >= grid_id_start").withColumn("_first", F.coalesce(F.sum(n).over(w), F.lit(0)))
    cells = first.select("row", "_first", "grid_id_start", F.explode(F.sequence("grid_id_start", "grid_id_stop")).alias("grid_id"))
    return cells.select((F.col("_first") + F.col("grid_id") - F.col("grid_id_start")).cast("int").alias("mirror_id"), "row", "grid_id")
