"""Spectra, resampling and block-wise gradient histograms of patches, as Spark jobs over ``patch, y, x, v``.

All three are separable sums: a pixel's value goes, weighted, to the rows of the
result that need it, first along one side and then along the other, and grouped
sums with map-side combining gather it. A patch of h x w pixels makes h * w * w
and h * w * h weighted values for its spectrum, never one table in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.functions.patches import min_max
from facetwatch.functions.regions import padded

#: The small steps of the published measures.
STEP, BLOCK_STEP, BLOCK_MOST = 1e-6, 1e-5, 0.2


def sized(pixels: DataFrame) -> DataFrame:
    """``pixels`` with the height and width of their patch."""
    w = Window.partitionBy("patch")
    return pixels.withColumns({"h": F.max("y").over(w) + 1, "w": F.max("x").over(w) + 1})


def dft(pixels: DataFrame) -> DataFrame:
    """``patch, h, w, k, l, magnitude`` of the two-dimensional discrete Fourier transform, ``k`` along y, ``l`` along x.

    Factors are cosine and sine of whole parts of a turn, so they are the same wherever they come up.
    """
    turn = lambda k, x, n: F.lit(2 * math.pi) * ((F.col(k) * F.col(x)) % F.col(n)) / F.col(n)
    rows = sized(pixels.select("patch", "y", "x", F.col("v").cast("double").alias("v"))).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    a = turn("l", "x", "w")
    lines = rows.groupBy("patch", "h", "w", "y", "l").agg(F.sum(F.col("v") * F.cos(a)).alias("re"), (-F.sum(F.col("v") * F.sin(a))).alias("im"))
    lines = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    c, s = F.cos(turn("k", "y", "h")), F.sin(turn("k", "y", "h"))
    out = lines.groupBy("patch", "h", "w", "k", "l").agg(F.sum(F.col("re") * c + F.col("im") * s).alias("re"), F.sum(F.col("im") * c - F.col("re") * s).alias("im"))
    return out.select("patch", "h", "w", "k", "l", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))


def _centred(n: str, k: str) -> Column:
    """Place of a frequency when the lowest is put in the middle."""
    return (F.col(k) + F.floor(F.col(n) / 2)) % F.col(n)


def _within(place: Column, n: str, reach: Column) -> Column:
    middle = F.floor(F.col(n) / 2)
    return (place >= middle - reach) & (place < middle + reach)


def spectrum_bands(spectrum: DataFrame, width: int = 2) -> DataFrame:
    """``patch, fft_low, fft_high, fft_ratio``: mean magnitude in the middle and at the border of the centred spectrum.

    The middle is a square of twice ``width``; the border are strips of ``width`` on all four
    sides, so that their corners count twice.
    """
    i, j, m = _centred("h", "k"), _centred("w", "l"), F.col("magnitude")
    middle = _within(i, "h", F.lit(width)) & _within(j, "w", F.lit(width))
    strips = sum(((c < width).cast("int") + (c >= F.col(n) - width).cast("int") for c, n in ((i, "h"), (j, "w"))), F.lit(0))
    out = spectrum.groupBy("patch").agg(F.avg(F.when(middle, m)).alias("fft_low"), (F.sum(m * strips) / F.sum(strips)).alias("fft_high"))
    return out.withColumn("fft_ratio", F.col("fft_high") / (F.col("fft_low") + STEP))


def high_frequency(pixels: DataFrame) -> DataFrame:
    """``patch, high_frequency``: share of magnitude outside the middle third of the spectrum of the stretched patch."""
    spectrum = dft(min_max(pixels).select("patch", "y", "x", F.col("stretched").alias("v")))
    middle = _within(_centred("h", "k"), "h", F.floor(F.col("h") / 6)) & _within(_centred("w", "l"), "w", F.floor(F.col("w") / 6))
    m = F.col("magnitude")
    return spectrum.groupBy("patch").agg((F.coalesce(F.sum(F.when(~middle, m)), F.lit(0.0)) / (F.sum(m) + STEP)).alias("high_frequency"))


def resized(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """``patch, y, x, v``: area means on a grid of any size, smaller or larger.

    A pixel gives its value to every cell that it overlaps, in proportion to the overlap;
    overlaps are whole numbers over the number of pixels of a side, divided at the end, so that
    means of whole levels are exact sums and level areas have equal ones.
    """
    rows = sized(pixels.select("patch", "y", "x", F.col("v").cast("double").alias("v")))

    def cells(c: str, n: str, many: int) -> Column:
        first, last = F.floor(F.col(c) * many / F.col(n)), F.ceil((F.col(c) + 1) * many / F.col(n)) - 1
        return F.explode(F.sequence(first, last))

    def share(c: str, cell: str, n: str, many: int) -> Column:
        return F.least((F.col(cell) + 1) * F.col(n), (F.col(c) + 1) * many) - F.greatest(F.col(cell) * F.col(n), F.col(c) * many)

    rows = rows.withColumn("_i", cells("y", "h", height)).withColumn("v", F.col("v") * share("y", "_i", "h", height))
    rows = rows.groupBy("patch", "h", "w", "_i", "x").agg(F.sum("v").alias("v"))
    rows = rows.withColumn("_j", cells("x", "w", width)).withColumn("v", F.col("v") * share("x", "_j", "w", width))
    return rows.groupBy("patch", "h", "w", "_i", "_j").agg(F.sum("v").alias("v")).select("patch", F.col("_i").cast("int").alias("y"), F.col("_j").cast("int").alias("x"), (F.col("v") / (F.col("h") * F.col("w"))).alias("v"))


def hog_blocks(pixels: DataFrame, cell: int = 4, bins: int = 9, block: int = 2) -> DataFrame:
    """``patch, block_y, block_x, cell_y, cell_x, bin, value``: direction histograms of cells in overlapping blocks.

    A cell's histogram is its mean gradient strength by unsigned direction; each block of
    cells is scaled to unit length, cut off at a fifth and scaled again. On the border the
    gradient across it is 0; pixels beyond the last whole cell are left out. Empty bins have no rows.
    """
    rows = padded(sized(pixels.select("patch", "y", "x", F.col("v").cast("double").alias("v"))), ("v", "h", "w"))
    side = {"e": (0, 1), "w_": (0, -1), "s": (1, 0), "n": (-1, 0)}
    sent = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for n, (dy, dx) in side.items())))
    wide = rows.select("patch", "h", "w", "y", "x", "v", sent.alias("s")).select("patch", "h", "w", (F.col("y") - F.col("s.dy")).alias("y"), (F.col("x") - F.col("s.dx")).alias("x"), F.col("s.n").alias("n"), "v")
    wide = wide.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") < F.col("w")))
    g = wide.groupBy("patch", "h", "w", "y", "x").agg(*(F.max(F.when(F.col("n") == n, F.col("v"))).alias(n) for n in side))
    inner = lambda c, n: (F.col(c) > 0) & (F.col(c) < F.col(n) - 1)
    gx, gy = F.when(inner("x", "w"), F.col("e") - F.col("w_")).otherwise(0.0), F.when(inner("y", "h"), F.col("s") - F.col("n")).otherwise(0.0)
    turn = F.pmod(F.degrees(F.atan2(gy, gx)), F.lit(180.0))
    k = (F.floor(F.round(turn / (180.0 / bins), 9)) % bins).cast("int")
    down, right = F.floor(F.col("h") / cell), F.floor(F.col("w") / cell)
    rows = g.select("patch", down.alias("_down"), right.alias("_right"), F.floor(F.col("y") / cell).alias("cell_y"), F.floor(F.col("x") / cell).alias("cell_x"), k.alias("bin"), F.sqrt(gx * gx + gy * gy).alias("m"))
    cells = rows.where("cell_y < _down and cell_x < _right").groupBy("patch", "_down", "_right", "cell_y", "cell_x", "bin").agg((F.sum("m") / (cell * cell)).alias("v")).where("v > 0")
    begin = lambda c, end: F.explode(F.sequence(F.greatest(F.col(c) - (block - 1), F.lit(0)), F.least(F.col(c), F.col(end) - block)))
    fits = (F.col("_down") >= block) & (F.col("_right") >= block)
    rows = cells.where(fits).withColumn("block_y", begin("cell_y", "_down")).withColumn("block_x", begin("cell_x", "_right"))
    w = Window.partitionBy("patch", "block_y", "block_x")
    scaled = lambda: F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(w) + BLOCK_STEP**2)
    rows = rows.withColumn("v", scaled()).withColumn("v", F.least("v", F.lit(BLOCK_MOST))).withColumn("v", scaled())
    return rows.select("patch", "block_y", "block_x", (F.col("cell_y") - F.col("block_y")).alias("cell_y"), (F.col("cell_x") - F.col("block_x")).alias("cell_x"), "bin", F.col("v").alias("value"))
