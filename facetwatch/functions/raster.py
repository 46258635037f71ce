"""Polygons to pixels, and frames cut to facets, as Spark jobs.

A polygon is filled line by line: each edge is exploded into the lines that it
crosses, crossings of a line are ordered by a window, and the spans between the
first and second, third and fourth crossing and so on are exploded into pixels.
Its border is drawn besides, one pixel wide, so a pixel that the outline passes
through belongs to the polygon. All positions are whole numbers or exact ratios of
them. Work and shuffles follow the number of lines and pixels; no polygon or
frame is held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.operators.lineage import cut


def edges(polygons: DataFrame) -> DataFrame:
    """``key, x0, y0, x1, y1`` of polygons ``key, points array<struct<x, y>>``; the last corner is joined to the first.

    A polygon without corners has no edges; one corner is an edge without length.
    """
    rows = polygons.select("key", "points", F.posexplode("points").alias("k", "p"))
    following = F.element_at("points", ((F.col("k") + 1) % F.size("points") + 1).cast("int"))
    return rows.select("key", F.col("p.x").cast("long").alias("x0"), F.col("p.y").cast("long").alias("y0"), following["x"].cast("long").alias("x1"), following["y"].cast("long").alias("y1"))


def boxes(polygons: DataFrame) -> DataFrame:
    """``key, x0, y0, width, height`` of the smallest box with all corners."""
    c = F.col("points")
    lo, hi = (lambda n: F.array_min(F.transform(c, lambda p: p[n])).cast("long")), (lambda n: F.array_max(F.transform(c, lambda p: p[n])).cast("long"))
    return polygons.where(F.size(c) > 0).select("key", lo("x").alias("x0"), lo("y").alias("y0"), (hi("x") - lo("x") + 1).alias("width"), (hi("y") - lo("y") + 1).alias("height"))


def _floor_div(a, b):
    """Floor of a ratio of whole numbers, ``b`` above 0."""
    return F.call_function("div", a - F.pmod(a, b), b)


def spans(lines: DataFrame) -> DataFrame:
    """``key, y, first, last``: what the even-odd rule fills of each line; a line between a first and second crossing holds the whole numbers from one to the other."""
    e = lines.where("y0 <> y1")
    up = F.col("y0") < F.col("y1")
    e = e.select("key", *(F.when(up, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("x0", "x1", "xa"), ("y0", "y1", "ya"), ("x1", "x0", "xb"), ("y1", "y0", "yb"))))
    # An edge crosses the lines from its upper end to above its lower end, so a corner between two edges counts once.
    c = e.withColumn("y", F.explode(F.sequence(F.col("ya"), F.col("yb") - 1))).withColumn("h", F.col("yb") - F.col("ya"))
    c = c.withColumn("top", F.col("xa") * F.col("h") + (F.col("y") - F.col("ya")) * (F.col("xb") - F.col("xa"))).select("key", "y", "top", "h")
    w = Window.partitionBy("key", "y").orderBy(F.col("top") / F.col("h"), "top", "h")
    c = c.select("key", "y", "top", "h", F.row_number().over(w).alias("k"), F.lead("top").over(w).alias("top2"), F.lead("h").over(w).alias("h2")).where("k % 2 = 1")
    return c.select("key", "y", (-_floor_div(-F.col("top"), F.col("h"))).alias("first"), _floor_div(F.col("top2"), F.col("h2")).alias("last")).where("first <= last")


def border(lines: DataFrame) -> DataFrame:
    """``key, y, x``: one pixel for each step along an edge's longer side, from its left end; halves go to the side of that end."""
    swap = (F.col("x0") > F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") > F.col("y1")))
    e = lines.select("key", *(F.when(swap, F.col(b)).otherwise(F.col(a)).alias(n) for a, b, n in (("x0", "x1", "xa"), ("y0", "y1", "ya"), ("x1", "x0", "xb"), ("y1", "y0", "yb"))))
    e = e.withColumn("dx", F.col("xb") - F.col("xa")).withColumn("dy", F.col("yb") - F.col("ya"))
    e = e.withColumn("long", F.greatest("dx", F.abs("dy"))).withColumn("short", F.least("dx", F.abs("dy"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("long"))))
    side = F.when(F.col("long") == 0, F.lit(0)).otherwise(_floor_div(2 * F.col("k") * F.col("short") + F.col("long") - 1, F.greatest(2 * F.col("long"), F.lit(1))))
    flat, down = F.col("dx") >= F.abs("dy"), F.signum("dy").cast("long")
    return e.select("key", (F.col("ya") + down * F.when(flat, side).otherwise(F.col("k"))).alias("y"), (F.col("xa") + F.when(flat, F.col("k")).otherwise(side)).alias("x"))


def polygon_pixels(polygons: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """``key, y, x`` of the pixels in each polygon or on its border, once each; those off a frame of a given size are left out."""
    lines = edges(polygons)
    filled = spans(lines).select("key", "y", F.explode(F.sequence("first", "last")).alias("x"))
    out = filled.unionByName(border(lines)).distinct()
    if height is not None:
        out = out.where((F.col("y") >= 0) & (F.col("y") < height))
    if width is not None:
        out = out.where((F.col("x") >= 0) & (F.col("x") < width))
    return out


def box_places(polygons: DataFrame) -> DataFrame:
    """``key, y, x, frame_y, frame_x, inside``: every place of each polygon's box, in the box and in the frame."""
    box = boxes(polygons).select("key", "x0", "y0", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("y"))
    box = box.select("key", "x0", "y0", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("x"))
    places = box.select("key", "y", "x", (F.col("y0") + F.col("y")).alias("frame_y"), (F.col("x0") + F.col("x")).alias("frame_x"))
    own = polygon_pixels(polygons).select("key", F.col("y").alias("frame_y"), F.col("x").alias("frame_x"), F.lit(True).alias("_in"))
    return places.join(own, ["key", "frame_y", "frame_x"], "left").select("key", "y", "x", "frame_y", "frame_x", F.coalesce("_in", F.lit(False)).alias("inside"))


def cut_facets(frames: DataFrame, polygons: DataFrame, value: str | list[str] = "v", broadcast_rows: int = 500_000) -> DataFrame:
    """``frame, key, y, x`` and the values of the pixels of each polygon in each frame; places are those of the polygon's box.

    ``frames``: ``frame, y, x`` and a value per pixel. The background of a box, and what of it
    is off the frame, has no rows. A polygon's pixels are made once for all frames; they
    are broadcast while they are at most ``broadcast_rows``, else both sides meet by place.
    """
    corner = boxes(polygons).select("key", "x0", "y0")
    inside = cut(polygon_pixels(polygons).join(corner, "key").select("key", "y", "x", (F.col("y") - F.col("y0")).alias("in_y"), (F.col("x") - F.col("x0")).alias("in_x")))
    hit = frames.join(F.broadcast(inside) if inside.count() <= broadcast_rows else inside, ["y", "x"])
    return hit.select("frame", "key", F.col("in_y").alias("y"), F.col("in_x").alias("x"), *([value] if isinstance(value, str) else value))
