"""Measures of whole frames from a mergeable state, over colour pixels ``patch, y, x, r, g, b``.

A frame's state is two small tables: how many pixels have each gray level in each
combination of zones, and sums of colour terms over the frame and its zones. Both
add up, so the state of a frame may be made in parts, from tiles or partitions,
and merged; percentiles, shares, entropy and asymmetry come from the counts without
a second look at the pixels. Sharpness needs neighbours and is a table of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Union

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.functions.colours import GRAY, hsv
from facetwatch.functions.regions import gradients

#: Hue, saturation and value of warm and of bright pixels, levels of dark and bright ones, and of the sky.
WARM_BELOW, WARM_ABOVE, WARM_VALUE, WARM_SATURATION = 25, 160, 180, 60
BRIGHT_VALUE, BRIGHT_SATURATION = 200, 80
DARK, BRIGHT, OVEREXPOSED = 40, 220, 250
GRAY_SATURATION, GRAY_VALUE = 30, 150
WARM_ROWS = 400
#: From linear RGB to XYZ over the white point, and the two branches of the lightness curve.
XYZ = {"x": (0.412453 / 0.950456, 0.357580 / 0.950456, 0.180423 / 0.950456), "y": (0.212671, 0.715160, 0.072169), "z": (0.019334 / 1.088754, 0.119193 / 1.088754, 0.950227 / 1.088754)}


@dataclass(frozen=True)
class Circle:
    """The camera housing, in shares of the frame; pixels in it are left out of brightness."""

    y: float
    x: float
    radius: float


#: The housing as the two sets of measures take it.
HOUSING, HOUSING_SMALL = Circle(0.42, 0.65, 0.22), Circle(0.38, 0.52, 0.12)


#: A side of all frames, or the column that has it for each pixel.
Side = Union[int, Column]


def _share_of(side: Side, over: float, times: float = 1) -> Column:
    """The whole part of a share of a side."""
    return F.floor((F.lit(side) if isinstance(side, int) else side) * times / over)


def zones(height: Side, width: Side, circle: Circle) -> dict[str, Column]:
    """Conditions on a pixel's place: free of the housing, outer thirds, and the sky's strip."""
    y, x, h, w = F.col("y"), F.col("x"), F.lit(height), F.lit(width)
    dy, dx, r = y - _share_of(h, 1, circle.y), x - _share_of(w, 1, circle.x), _share_of(F.least(h, w), 1, circle.radius)
    return {
        "free": dy * dy + dx * dx > r * r, "left": x < _share_of(w, 3), "right": x >= _share_of(w, 3, 2), "top": y < _share_of(h, 3), "bottom": y >= _share_of(h, 3, 2), "sky": y < _share_of(h, 6)
    }


def lab(pixels: DataFrame) -> DataFrame:
    """Adds ``lab_a`` and ``lab_b``, whole numbers around 128."""
    linear = {c: F.when(F.col(c) / 255.0 > 0.04045, F.pow((F.col(c) / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(F.col(c) / 255.0 / 12.92) for c in "rgb"}
    pixels = pixels.withColumns({f"_l{c}": e for c, e in linear.items()})
    pixels = pixels.withColumns({f"_{n}": sum((F.col(f"_l{c}") * w for c, w in zip("rgb", ws)), F.lit(0.0)) for n, ws in XYZ.items()})
    curve = {n: F.when(F.col(f"_{n}") > 0.008856, F.cbrt(f"_{n}")).otherwise(7.787 * F.col(f"_{n}") + 16 / 116) for n in XYZ}
    near = lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(e + 128)))
    return pixels.withColumns({"lab_a": near(500 * (curve["x"] - curve["y"])), "lab_b": near(200 * (curve["y"] - curve["z"]))}).drop("_lr", "_lg", "_lb", "_x", "_y", "_z")


def level_state(pixels: DataFrame, height: Side, width: Side, circle: Circle) -> DataFrame:
    """``patch, v, free, left, right, top, bottom, sky, n``: pixels by gray level and zones; states of parts of a frame add up."""
    v = F.round(sum((F.col(c) * w for c, w in GRAY.items()), F.lit(0.0))).cast("int")
    return pixels.groupBy("patch", v.alias("v"), *(z.alias(n) for n, z in zones(height, width, circle).items())).agg(F.count("*").alias("n"))


def merged(*states: DataFrame) -> DataFrame:
    """One level state of several, of other parts of the same frames or of other frames."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*(c for c in out.columns if c != "n")).agg(F.sum("n").alias("n"))


def _percentile(state: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of counted levels, by running counts; a frame has 256 levels at most."""
    counts = state.groupBy("patch", "v").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("patch")
    counts = counts.withColumns({"_end": F.sum("n").over(w.orderBy("v")), "_all": F.sum("n").over(w)})
    # The level at a rank is the first whose running count goes beyond it.
    at = lambda rank: F.min(F.when(F.col("_end") > rank, F.col("v")))
    place = {k: (F.col("_all") - 1) * F.lit(p) for k, p in shares.items()}
    low = {k: at(F.floor(e)) for k, e in place.items()}
    high = {k: at(F.ceil(e)) for k, e in place.items()}
    part = {k: F.max(e - F.floor(e)) for k, e in place.items()}
    return counts.groupBy("patch").agg(*((low[k] + (high[k] - low[k]) * part[k]).alias(k) for k in shares))


def brightness(state: DataFrame) -> DataFrame:
    """Brightness outside the housing, its percentiles, shares and entropy, and the asymmetry of the frame, from a level state."""
    n, v = F.col("n"), F.col("v").cast("double")

    def mean(zone: str) -> Column:
        return F.sum(F.when(F.col(zone), n * v)) / F.sum(F.when(F.col(zone), n))

    free = F.sum(F.when(F.col("free"), n))
    spread = F.sum(F.when(F.col("free"), n * v * v)) / free - mean("free") * mean("free")
    out = state.groupBy("patch").agg(
        mean("free").alias("mean_brightness"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std_brightness"), (F.sum(F.when(F.col("free") & (v < DARK), n).otherwise(0)) / free).alias("dark_fraction"),
        (F.sum(F.when(F.col("free") & (v > BRIGHT), n).otherwise(0)) / free).alias("bright_fraction"), (mean("left") - mean("right")).alias("lr_signed"), (mean("top") - mean("bottom")).alias("tb_signed"), mean("sky").alias("sky_brightness"),
    )
    inside = state.where("free")
    levels = inside.groupBy("patch", "v").agg(F.sum("n").cast("double").alias("n"))
    entropy = levels.groupBy("patch").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
    ends = _percentile(inside, {"p10_brightness": 0.1, "p90_brightness": 0.9}).withColumn("dynamic_range", F.col("p90_brightness") - F.col("p10_brightness"))
    out = out.join(entropy, "patch", "left").join(ends, "patch", "left")
    return out.withColumns({"lr_asymmetry": F.abs("lr_signed"), "tb_asymmetry": F.abs("tb_signed")})


def _share(hit: Column, of: Column | None = None) -> Column:
    return F.avg((hit if of is None else F.when(of, hit)).cast("double"))


def _warm() -> Column:
    return ((F.col("h") < WARM_BELOW) | (F.col("h") > WARM_ABOVE)) & (F.col("val") > WARM_VALUE) & (F.col("s") > WARM_SATURATION)


def _vivid() -> Column:
    return (F.col("val") > BRIGHT_VALUE) & (F.col("s") > BRIGHT_SATURATION)


def colour_sums(pixels: DataFrame, height: Side, width: Side, circle: Circle) -> DataFrame:
    """Warm and vivid shares, mean colours, the sky's blue and its overexposed share."""
    zone = zones(height, width, circle)
    mean = lambda c, of=None: F.avg((F.col(c) if of is None else F.when(of, F.col(c))).cast("double"))
    return lab(hsv(pixels)).groupBy("patch").agg(
        _share(_warm(), zone["free"]).alias("warm_bright_fraction"), _share(_vivid(), zone["free"]).alias("bright_saturated_frac"), (mean("b", zone["sky"]) / (mean("r", zone["sky"]) + 1)).alias("sky_blue_ratio"),
        mean("s", zone["free"]).alias("mean_saturation"), mean("h", zone["free"]).alias("mean_hue"), ((mean("b") + 1) / (mean("r") + 1)).alias("br_ratio"), mean("lab_a").alias("mean_a"), mean("lab_b").alias("mean_b"),
        (100 * _share(F.col("val") > OVEREXPOSED, zone["top"])).alias("overexposed_pct"),
    )


def sharpness(pixels: DataFrame) -> DataFrame:
    """``patch, sharpness``: deviation of the Laplacian of the gray level."""
    v = F.round(sum((F.col(c) * w for c, w in GRAY.items()), F.lit(0.0))).cast("int")
    return gradients(pixels.select("patch", "y", "x", v.alias("v")), mirror=True).groupBy("patch").agg(F.stddev_pop("lap").alias("sharpness"))


def frame_quality(pixels: DataFrame, height: Side, width: Side) -> DataFrame:
    """Brightness outside the housing, sharpness, percentage of warm pixels in the upper rows, share of vivid ones."""
    free = zones(height, width, HOUSING)["free"]
    light = brightness(level_state(pixels, height, width, HOUSING)).select("patch", "mean_brightness", "std_brightness")
    colour = hsv(pixels).groupBy("patch").agg((100 * _share(_warm(), F.col("y") < WARM_ROWS)).alias("warm_pixel_ratio"), _share(_vivid(), free).alias("bright_saturated_frac"))
    return light.join(colour, "patch").join(sharpness(pixels), "patch")


def frame_details(pixels: DataFrame, height: Side, width: Side) -> DataFrame:
    """The long list: brightness and its percentiles, warm and vivid shares, asymmetry, sky, colour means, entropy, sharpness."""
    light = brightness(level_state(pixels, height, width, HOUSING_SMALL))
    return light.join(colour_sums(pixels, height, width, HOUSING_SMALL), "patch").join(sharpness(pixels), "patch")


def frame_sky(pixels: DataFrame, height: Side) -> DataFrame:
    """Saturation, value, overexposed and gray percentage and blue share of the upper third, rounded as published."""
    top = hsv(pixels.where(F.col("y") < _share_of(height, 3)))
    total = F.col("r") + F.col("g") + F.col("b") + 1e-6
    one = {
        "sat_mean": F.avg("s"), "val_mean": F.avg("val"), "val_std": F.stddev_pop("val"), "overexposed_pct": 100 * _share(F.col("val") > OVEREXPOSED), "gray_pct": 100 * _share((F.col("s") < GRAY_SATURATION) & (F.col("val") > GRAY_VALUE))
    }
    return top.groupBy("patch").agg(*(F.round(e + 1e-9, 1).alias(n) for n, e in one.items()), F.round(F.avg(F.col("b") / total) + 1e-9, 3).alias("blue_ratio"))
