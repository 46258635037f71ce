"""Extractor and clusterer as plan functions, run for all facets in one plan.

An extractor turns pixels ``patch, y, x, v`` into ``patch, features``; a clusterer turns
``unit, patch, features`` into ``unit, patch, cluster``, for each unit on its own. Both take
and give DataFrames, so a user's own functions join in on the cluster and no facet is
gathered into a task. Patches of a unit must be of one size, where the extractor's
vector depends on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwatch.functions import spectra
from facetwatch.operators import ml

Extractor = Callable[[DataFrame], DataFrame]
Clusterer = Callable[[DataFrame], DataFrame]


def raw_pixels(pixels: DataFrame) -> DataFrame:
    """Gray levels over 255 in raster order."""
    rows = pixels.groupBy("patch").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("_p"))
    return rows.select("patch", F.transform("_p", lambda p: p["v"] / F.lit(255.0)).alias("features"))


def small_pixels(height: int = 18, width: int = 16) -> Extractor:
    """Gray levels over 255 after resizing; patches of any size."""
    return lambda pixels: raw_pixels(spectra.resized(pixels, height, width))


def statistics(pixels: DataFrame) -> DataFrame:
    """Mean, deviation, smallest, largest, lower and upper quartile."""
    v = F.col("v").cast("double")
    return pixels.groupBy("patch").agg(F.array(F.avg(v), F.stddev_pop(v), F.min(v), F.max(v), F.percentile(v, 0.25), F.percentile(v, 0.75)).alias("features"))


def block_histograms(pixels: DataFrame) -> DataFrame:
    """Direction histograms of overlapping blocks as one vector; empty bins are 0."""
    size = pixels.groupBy("patch").agg(F.floor((F.max("y") + 1) / 4).alias("_down"), F.floor((F.max("x") + 1) / 4).alias("_right"))
    rows = spectra.hog_blocks(pixels).join(size, "patch")
    place = ((F.col("block_y") * (F.col("_right") - 1) + F.col("block_x")) * 4 + F.col("cell_y") * 2 + F.col("cell_x")) * 9 + F.col("bin")
    maps = rows.groupBy("patch").agg(F.map_from_entries(F.collect_list(F.struct(place.cast("long"), "value"))).alias("_m"))
    many = F.greatest(F.col("_down") - 1, F.lit(0)) * F.greatest(F.col("_right") - 1, F.lit(0)) * 36
    full = F.when(many > 0, F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))
    return size.join(maps, "patch", "left").select("patch", full.alias("features"))


def by_dbscan(eps: float = 1.75, min_samples: int = 2) -> Clusterer:
    return lambda vectors: ml.dbscan(vectors, "unit", ["patch"], "features", eps, min_samples)


def by_kmeans(k: int = 3, rounds: int = 20) -> Clusterer:
    return lambda vectors: ml.grouped_kmeans(vectors, "unit", "patch", "features", k, rounds)[0]


EXTRACTORS: dict[str, Extractor] = {"raw": raw_pixels, "small": small_pixels(), "statistics": statistics, "hog": block_histograms}
CLUSTERERS: dict[str, Clusterer] = {"dbscan": by_dbscan(), "kmeans": by_kmeans()}


def vectors(pixels: DataFrame, units: DataFrame, extractor: str | Extractor) -> DataFrame:
    """``unit, patch, features``: what clusterers take, also several of them."""
    extract = EXTRACTORS[extractor] if isinstance(extractor, str) else extractor
    return extract(pixels).join(units.select("patch", "unit"), "patch").select("unit", "patch", "features")


def process(pixels: DataFrame, units: DataFrame, extractor: str | Extractor, clusterer: str | Clusterer) -> DataFrame:
    """``unit, patch, cluster`` for all units; ``units``: ``patch, unit``. Names are those of the registries."""
    for name, known in ((extractor, EXTRACTORS), (clusterer, CLUSTERERS)):
        if isinstance(name, str) and name not in known:
            raise KeyError(f"unknown: {name}; known: {sorted(known)}")
    cluster = CLUSTERERS[clusterer] if isinstance(clusterer, str) else clusterer
    return cluster(vectors(pixels, units, extractor)).select("unit", "patch", "cluster")


def noise_of_frames(labels: DataFrame, frames: DataFrame) -> DataFrame:
    """``frame, unit``: which units are noise in each frame; ``frames``: ``patch, frame``."""
    return labels.where("cluster = -1").join(frames.select("patch", "frame"), "patch").select("frame", "unit").distinct()
