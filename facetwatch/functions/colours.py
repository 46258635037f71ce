"""Colour features as grouped Spark jobs over a pixel table ``patch, y, x, r, g, b`` of levels 0..255."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the gray level, and the small steps of the published measures.
GRAY = {"r": 0.299, "g": 0.587, "b": 0.114}
STEP = 1e-6


def gray(pixels: DataFrame, rounded: bool = True, key: str = "patch") -> DataFrame:
    """``patch, y, x, v``: gray levels, for the measures in ``patches``; rounded, or cut off."""
    v = sum((F.col(c) * w for c, w in GRAY.items()), F.lit(0.0))
    return pixels.select(key, "y", "x", (F.round(v) if rounded else F.floor(v + 1e-9)).cast("int").alias("v"))


def levels_and_slopes(pixels: DataFrame) -> DataFrame:
    """``patch, entropy, gradient``: entropy of the gray levels in bits, and the mean Sobel magnitude of all pixels, with the pixel behind the border beyond it."""
    from facetwatch.functions.patches import level_entropy
    from facetwatch.functions.regions import gradients

    rows = gray(pixels)
    slope = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return level_entropy(rows).join(gradients(rows, mirror=True).groupBy("patch").agg(F.avg(slope).alias("gradient")), "patch")


def hsv(pixels: DataFrame) -> DataFrame:
    """Adds ``h`` (0..179), ``s`` and ``val`` (0..255), rounded."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    turn = F.when(d == 0, 0.0).when(top == r, 60 * (g - b) / d).when(top == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    turn = F.when(turn < 0, turn + 360).otherwise(turn)
    return pixels.withColumns({"h": F.round(turn / 2) % 180, "s": F.round(F.when(top > 0, 255 * d / top).otherwise(0.0)), "val": top})


def channel_stats(pixels: DataFrame) -> DataFrame:
    """Mean, deviation, skewness and excess kurtosis of each channel; quartile, bright and dark share, entropy and gradient of the gray level."""
    v = F.round(sum((F.col(c) * w for c, w in GRAY.items()), F.lit(0.0)))
    one = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in "rgb" for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("skew", F.skewness), ("kurt", F.kurtosis))]
    out = pixels.groupBy("patch").agg(*one, F.percentile(v, 0.75).alias("p75"), F.avg((v > 200).cast("double")).alias("bright"), F.avg((v < 50).cast("double")).alias("dark"))
    return out.join(levels_and_slopes(pixels), "patch")


def _shares(rows: DataFrame, bins) -> DataFrame:
    """``patch, bin, n, p`` of a histogram, with shares as published: over the number of pixels and a small step."""
    counts = rows.groupBy("patch", bins.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / (F.sum("n").over(Window.partitionBy("patch")) + STEP))


def colour_ratios(pixels: DataFrame, bins: int = 16) -> DataFrame:
    """Channel ratios, hue, saturation and value statistics, hue entropy and peak, uniformity and smoothness of the gray level."""
    rows = hsv(pixels)
    m = {c: F.avg(F.col(c).cast("double")) for c in "rgb"}
    total = m["r"] + m["g"] + m["b"]
    stats = rows.groupBy("patch").agg(
        *(F.try_divide(m[c], total).alias(f"{c}_ratio") for c in "rgb"), (m["r"] / (m["g"] + STEP)).alias("rg_ratio"), (m["r"] / (m["b"] + STEP)).alias("rb_ratio"), (m["g"] / (m["b"] + STEP)).alias("gb_ratio"),
        *(f(c).alias(f"{n}_{k}") for n, c in (("hue", "h"), ("sat", "s"), ("val", "val")) for k, f in (("mean", F.avg), ("std", F.stddev_pop))),
    )
    hues = _shares(rows, F.floor(F.col("h") * bins / 180).cast("int")).groupBy("patch").agg((-F.sum(F.col("p") * F.log2(F.col("p") + STEP))).alias("hue_entropy"), F.max_by("bin", F.struct("n", -F.col("bin"))).alias("hue_peak"))
    levels = gray(pixels)
    even = _shares(levels, F.col("v")).groupBy("patch").agg(F.sum(F.col("p") * F.col("p")).alias("uniformity"))
    smooth = levels.groupBy("patch").agg((1 - 1 / (1 + F.var_pop("v"))).alias("smoothness"))
    return stats.join(hues, "patch").join(even, "patch").join(smooth, "patch")


def colour_histogram(pixels: DataFrame) -> DataFrame:
    """``patch, bin, value``; empty bins are left out.

    Bins 0 to 127 are counts of hue, saturation and value in 8 x 4 x 4 steps, scaled to unit
    length; bins from 128 on are shares of the 18 patterns of 16 points at radius 2.
    """
    from facetwatch.functions.patches import lbp_shares

    patterns = lbp_shares(gray(pixels), 16, 2.0).select("patch", (F.col("code") + 128).cast("int").alias("bin"), F.col("share").alias("value"))
    b = F.least(F.lit(7), F.floor(F.col("h") * 8 / 180)) * 16 + F.least(F.lit(3), F.floor(F.col("s") / 64)) * 4 + F.least(F.lit(3), F.floor(F.col("val") / 64))
    counts = hsv(pixels).groupBy("patch", b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    levels = counts.select("patch", "bin", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("patch")))).alias("value"))
    return levels.unionByName(patterns)


def advanced(pixels: DataFrame) -> DataFrame:
    """The long colour and texture set, one row per patch.

    Colour ratios, hue, saturation and value; shares of the first five patterns; co-occurrence of
    64 levels at 0 degrees; skewness and kurtosis of each channel; spectrum bands; edge density, spread
    of direction and corners; spatial moments; uniformity and smoothness.
    """
    from facetwatch.functions import patches, regions, spectra

    pixels = patches.dealt(pixels)
    levels = gray(pixels)
    patterns = patches.lbp_shares(levels).groupBy("patch").agg(*(F.coalesce(F.max(F.when(F.col("code") == k, F.col("share"))), F.lit(0.0)).alias(f"lbp_bin_{k}") for k in range(5)))
    texture = patches.glcm_features(patches.glcm(levels, 64, angles=1))
    shape = pixels.groupBy("patch").agg(*(f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in "rgb" for n, f in (("skewness", F.skewness), ("kurtosis", F.kurtosis))))
    parts = [patterns, texture, shape, spectra.spectrum_bands(spectra.dft(levels)), regions.edge_density(levels), regions.corners(levels), patches.spatial_moments(levels)]
    out = colour_ratios(pixels)
    for part in parts:
        out = out.join(part, "patch", "left")
    return out


def small_set(pixels: DataFrame) -> DataFrame:
    """Luminance, saturation, variance, gradient and skewness of the gray level, and its entropy in 32 bins."""
    rows = hsv(pixels).withColumn("v", F.round(sum((F.col(c) * w for c, w in GRAY.items()), F.lit(0.0))))
    stats = rows.groupBy("patch").agg(F.avg("v").alias("luminance"), F.avg("s").alias("saturation"), F.var_pop("v").alias("variance"), F.skewness("v").alias("skew"))
    counts = rows.groupBy("patch", F.floor(F.col("v") / 8).alias("bin")).agg(F.count("*").alias("n"))
    n, t = F.col("n").cast("double"), F.sum("n").cast("double")
    return stats.join(counts.groupBy("patch").agg((F.log2(t) - F.sum(n * F.log2(n)) / t).alias("entropy32")), "patch").join(levels_and_slopes(pixels).select("patch", "gradient"), "patch")
