"""The pixel stage: frames to facets to features, as Spark jobs over pixel rows.

Python only takes image bytes apart (``sources.images.frame_pixels``). Polygons become pixels
once for all frames, pixels meet them by place, and every measure is a grouped job of
``functions``. A patch is one facet of one frame; its number holds the frame's number and the
facet's, so that work on patches needs one long as a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.functions import colours, patches, raster, regions, spectra
from facetwatch.functions import frames as frame_functions
from facetwatch.operators.lineage import cut
from facetwatch.schemas import FEATURES
from facetwatch.sources.images import frame_pixels

#: Names that the standard vector has for measures of the plain families.
_NAMES = {c: f"glcm_{c}" for c in patches.GLCM}


def readable(frames: DataFrame) -> DataFrame:
    """The frames whose image could be decoded."""
    return frames.where("height > 0")


def pixel_rows(frames: DataFrame) -> DataFrame:
    """``frame, y, x, r, g, b, v`` of the readable frames; ``frame`` holds ``frame_id`` and ``ts``."""
    rows = frame_pixels(readable(frames), keep=["ts"])
    v = F.round(sum((F.col(c) * w for c, w in colours.GRAY.items()), F.lit(0.0))).cast("int")
    return rows.select(F.struct(F.col("frame").alias("frame_id"), "ts").alias("frame"), "y", "x", "r", "g", "b", v.alias("v"))


def _patches(rows: DataFrame) -> DataFrame:
    """``patch`` and what it is of; rows have ``frame`` and ``key``."""
    key = F.struct("frame.frame_id", "frame.ts", F.col("key").alias("mirror_id"))
    return rows.select(key.alias("patch"), "frame.frame_id", "frame.ts", F.col("key").alias("mirror_id"), "y", "x", "v", "r", "g", "b")


def facet_pixels(frames: DataFrame, facets: DataFrame) -> DataFrame:
    """``patch, frame_id, ts, mirror_id, y, x, v, r, g, b`` of the pixels inside each facet of each readable frame."""
    polygons = facets.select(F.col("mirror_id").alias("key"), "points")
    return _patches(raster.cut_facets(pixel_rows(frames), polygons, ["v", "r", "g", "b"]))


def crops(frames: DataFrame, facets: DataFrame) -> DataFrame:
    """``facet_pixels`` with the rest of each facet's box, which is 0: its background, and what is off the frame."""
    polygons = facets.select(F.col("mirror_id").alias("key"), "points")
    inside = raster.cut_facets(pixel_rows(frames), polygons, ["v", "r", "g", "b"]).select("frame", "key", "y", "x", "v", "r", "g", "b")
    places = cut(raster.box_places(polygons))
    y, x = F.col("frame_y"), F.col("frame_x")
    # Every frame has every place of every facet: the result's own size. The facets' places are broadcast behind their count.
    known = readable(frames).select(F.struct("frame_id", "ts").alias("frame"), "height", "width")
    every = known.crossJoin(F.broadcast(places) if places.count() <= 2_000_000 else places)
    empty = every.where(~F.col("inside") | (y < 0) | (x < 0) | (y >= F.col("height")) | (x >= F.col("width")))
    return _patches(inside.unionByName(empty.select("frame", "key", "y", "x", *(F.lit(0).alias(c) for c in ("v", "r", "g", "b")))))


def _named(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Features by patch as rows by frame and facet; a patch without any has NULLs."""
    return rows.select("patch").distinct().join(features, "patch", "left").select("patch.*", *(c for c in features.columns if c != "patch"))


def features(frames: DataFrame, facets: DataFrame, families: list[str] = patches.STANDARD) -> DataFrame:
    """``frame_id, ts, mirror_id, <features>`` by the families of ``functions.patches``, over the pixels inside each facet."""
    rows = cut(facet_pixels(frames, facets))
    return _named(rows, patches.family_table(rows, families))


def extract(frames: DataFrame, facets: DataFrame, families: list[str] | None = None) -> DataFrame:
    """``frame_id, ts, mirror_id, valid, <features>`` of every facet in every frame, over the whole boxes.

    By default the standard vector. ``valid`` is False, and features are NULL, where a
    frame cannot be read or a feature fails.
    """
    rows = cut(crops(frames, facets))
    table = patches.family_table(rows, families or patches.STANDARD)
    table = table.withColumnsRenamed(_NAMES) if families is None else table
    names = FEATURES if families is None else [c for c in table.columns if c != "patch"]
    grid = frames.select("frame_id", "ts").crossJoin(F.broadcast(facets.select("mirror_id")))
    out = grid.join(_named(rows, table).select("frame_id", "mirror_id", *names), ["frame_id", "mirror_id"], "left")
    valid = F.lit(True)
    for c in names:
        valid = valid & F.col(c).isNotNull()
    return out.select("frame_id", "ts", "mirror_id", valid.alias("valid"), *names)


def facet_masks(frames: DataFrame, facets: DataFrame, threshold: float = 0) -> DataFrame:
    """``mirror_id, y, x`` of each facet's mask, from the pixels of one reference frame (the first by time)."""
    rows = crops(readable(frames).orderBy("ts", "frame_id").limit(1), facets)
    return cut(regions.patch_mask(rows.select(F.col("mirror_id").alias("patch"), "y", "x", "v"), threshold).withColumnRenamed("patch", "mirror_id"))


def masked_features(frames: DataFrame, facets: DataFrame, masks: DataFrame) -> DataFrame:
    """``frame_id, ts, mirror_id`` and the masked measures: light inside the mask, edges and patterns over its core, co-occurrence within it.

    ``masks`` are those of :func:`facet_masks`, the same for all frames.
    """
    rows = cut(crops(frames, facets))
    held = cut(rows.select("patch", "mirror_id", "y", "x", "v").join(masks, ["mirror_id", "y", "x"]).drop("mirror_id"))
    mask = held.select("patch", "y", "x")
    texture = patches.glcm_features(patches.glcm(held))
    table = patches.photometric(held).drop("n").join(regions.masked_edges(rows, mask).drop("core_pixels"), "patch", "left")
    table = table.join(texture.withColumnsRenamed(_NAMES), "patch", "left").join(regions.masked_lbp(rows, mask).drop("core_pixels"), "patch", "left")
    return _named(rows, table)


def frame_measures(frames: DataFrame, kind: str = "quality") -> DataFrame:
    """``frame_id, ts`` and one row of frame measures per readable image: ``quality``, ``details``, ``sky`` or ``sun``."""
    rows = pixel_rows(frames).withColumnRenamed("frame", "patch")
    # The sides of a frame are its largest places; frames of one archive may differ in size.
    w = Window.partitionBy("patch")
    rows = rows.withColumns({"_high": F.max("y").over(w) + 1, "_wide": F.max("x").over(w) + 1})
    high, wide = F.col("_high"), F.col("_wide")
    measures = {
        "quality": lambda: frame_functions.frame_quality(rows, high, wide), "details": lambda: frame_functions.frame_details(rows, high, wide), "sky": lambda: frame_functions.frame_sky(rows, high), "sun": lambda: patches.sun_score(rows, wide, top=600)
    }
    found = measures[kind]()
    return found.select("patch.*", *(c for c in found.columns if c != "patch"))


def stack_images(frames: DataFrame) -> DataFrame:
    """``y, x, n, mean, median`` of a stack of images, exact; a place's gray levels are counts of 256 values at most."""
    return patches.mean_patch(pixel_rows(frames).withColumn("_all", F.lit(0)), "_all").drop("_all")


def crop_window(frames: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """``frame_id, ts, y, x, r, g, b, v``: the same fixed window of every readable image."""
    rows = pixel_rows(frames).where((F.col("y") >= top) & (F.col("y") < top + height) & (F.col("x") >= left) & (F.col("x") < left + width))
    return rows.select("frame.*", (F.col("y") - top).alias("y"), (F.col("x") - left).alias("x"), "r", "g", "b", "v")


def crop_arrays(rows: DataFrame, height: int = 18, width: int = 16) -> DataFrame:
    """``frame_id, ts, mirror_id, pixels``: crops as gray arrays of one size."""
    small = spectra.resized(rows.select("patch", "y", "x", "v"), height, width)
    arrays = small.groupBy("patch").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"]).alias("pixels"))
    return _named(rows, arrays)


def failures(obs: DataFrame) -> DataFrame:
    """Valid and failed observations per frame."""
    return obs.groupBy("frame_id").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_failed"))
