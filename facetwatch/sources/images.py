"""Image archives as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwatch.functions.times import base_name, frame_time


def read_frames(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, max_images: int | None = None, drop_invalid: bool = True) -> DataFrame:
    """``frame_id, ts, origin, height, width, channels, data`` of the images below a path.

    Unreadable files are dropped; with ``drop_invalid=False`` they stay, with
    negative sizes, and :func:`unreadable` counts them. ``max_images`` takes the
    first files by name.
    """
    rows = spark.read.format("image").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).option("dropInvalid", drop_invalid).load(path)
    rows = rows.select("image.*", F.col("_metadata.file_modification_time").alias("_mtime"))
    out = rows.select(base_name("origin").alias("frame_id"), frame_time("origin", F.col("_mtime")).alias("ts"), "origin", "height", "width", F.col("nChannels").alias("channels"), "data")
    return out if max_images is None else out.orderBy("origin").limit(max_images)


def frame_pixels(frames: DataFrame, rows_at_once: int = 64, keep: list[str] | None = None) -> DataFrame:
    """``frame, y, x, r, g, b``, and columns to ``keep``, of the frames of :func:`read_frames`; a gray image has three equal channels, alpha is left out.

    Python only takes the bytes apart, some rows of an image at a time; pixels become rows in
    the JVM. An image whose bytes do not fit its size has no rows.
    """

    keep = keep or []
    kinds = [f"{c} {frames.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (height, width, channels, data) in enumerate(zip(*(b.column(c) for c in ("height", "width", "channels", "data")), strict=True)):
                h, w, c, raw = height.as_py(), width.as_py(), channels.as_py(), data.as_py()
                if not raw or len(raw) != h * w * c:
                    continue
                a = np.frombuffer(raw, np.uint8).reshape(h, w, c)
                for at in range(0, h, rows_at_once):
                    part = a[at : at + rows_at_once].reshape(-1, c).astype(np.int16)
                    rgb = [part[:, k] for k in ((2, 1, 0) if c >= 3 else (0, 0, 0))]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("frame_id", *keep)), pa.array([at], pa.int32()), pa.array([w], pa.int32()), *(pa.array([v], pa.list_(pa.int16())) for v in rgb)], ["frame", *keep, "top", "w", "r", "g", "b"])

    lists = frames.select("frame_id", *keep, "height", "width", "channels", "data").mapInArrow(run, ", ".join(["frame string", *kinds, "top int, w int, r array<short>, g array<short>, b array<short>"]))
    rows = lists.select("frame", *keep, "top", "w", F.posexplode(F.arrays_zip("r", "g", "b")).alias("k", "p"))
    return rows.select("frame", *keep, (F.col("top") + F.floor(F.col("k") / F.col("w")).cast("int")).alias("y"), (F.col("k") % F.col("w")).alias("x"), *(F.col(f"p.{c}").cast("int").alias(c) for c in "rgb"))


def unreadable(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The files that could not be decoded."""
    return read_frames(spark, path, glob, drop_invalid=False).where("height < 0").select("frame_id", "origin")
