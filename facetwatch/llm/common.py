"""What several operators share: table paths, the shared folder, components, rows without others."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwatch.operators.lineage import components, cut, fewer, remove, scratch, settled, shared_dir

__all__ = ["BROADCAST_IDS", "components", "claim", "cut", "fewer", "release", "remove", "scratch", "settled", "shared_dir", "table", "without"]

#: What an operator keeps in a Python worker from one task to the next.
_kept: dict[str, dict] = {}

#: Rows up to which a table of ids is broadcast (about 16 bytes each).
BROADCAST_IDS = 500_000


def claim(operator: str) -> dict:
    """The worker's cache of an operator. A worker serves one operator after another; what earlier ones left is dropped."""
    others = [k for k in _kept if k != operator]
    for other in others:
        del _kept[other]
    if others:
        release()
    return _kept.setdefault(operator, {})


def release() -> None:
    """Gives memory that is free in this worker back to the machine; a worker outlives its tasks, and other workers share its executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such C library, it stays with the worker
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark from whatever store ``sf_dir`` names.

    A table in fewer splits than the session has cores (one file with one row group,
    say) is dealt out again, so that work on texts does not wait for one task.
    """
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def without(docs: DataFrame, lost: DataFrame, same: Column, broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` without the rows that meet ``same`` with a row of ``lost``.

    ``lost`` is written and counted; up to ``broadcast_rows`` rows it is
    broadcast, so that texts stay where they are, beyond that it is a shuffled join.
    """
    lost = cut(lost)
    return docs.join(F.broadcast(lost) if lost.count() <= broadcast_rows else lost, same, "left_anti")
