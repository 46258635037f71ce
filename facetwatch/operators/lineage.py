"""Cutting lineage in a shared folder, and connected components of a graph of rows."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that is unset and the session is a single process (tests) a
    temporary one is made; on a cluster that would be another folder on each machine.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='facetwatch-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that no later result reads, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``cut``, and a table that turned out small lies in few partitions, so that later shuffles write few files."""
    df = cut(df)
    return fewer(df, df.count())


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """No more partitions than ``rows`` ask for."""
    return df.coalesce(rows // 200_000 + 1)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, component)``.

    ``component`` is the smallest node that is reachable. Alternates the
    large-star and small-star steps of Kiveris et al. (2014): each step links
    the neighbours of a node to its smallest neighbour, so that every component
    ends as one star. Only the smallest neighbour of a node is aggregated (with
    map-side combining) and joined back, so a hub never becomes one task's
    list; a hub's join partition is split by adaptive execution. Each round is
    checkpointed, and rounds go on until nothing changes, which takes of the order of
    log(nodes) squared of them. A step has as many partitions as its edges ask for
    (``fewer``), so a small graph is one partition and shuffles nothing. Edges with a null
    end or equal ends are ignored.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    pairs = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rows, before = pairs.count(), None
    pairs = fewer(pairs, rows)
    while True:
        # Large star: every neighbour above u goes to u's smallest neighbour.
        both = fewer(pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), rows)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(fewer(small.unionByName(low.select("u", F.col("m").alias("v"))), rows).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
        pairs = fewer(pairs, rows)
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: Links that a task joins up at once.
PART_LINKS = 64_000


def components_in_parts(edges: DataFrame, band: Callable[[Column], Column]) -> DataFrame:
    """``components`` of ``edges(a long, b long)`` where most links are between nodes of one ``band``, which has a bounded number of them.

    Bands are dealt to parts of about ``PART_LINKS`` links, and each part joins its own up. Only
    links between bands are left for the rounds of ``components``, between the smallest nodes
    of what hangs together in a band; without such links there are no rounds.
    """
    pairs = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b", band(F.col("a")).alias("_a"), band(F.col("b")).alias("_b")))
    inner, outer = pairs.where("_a = _b"), pairs.where("_a <> _b").select("a", "b")
    parts = math.ceil(pairs.count() / PART_LINKS)

    def join_up(links: pa.Table) -> pa.Table:
        ends = np.concatenate([links.column(c).to_numpy() for c in "ab"])
        nodes, at = np.unique(ends, return_inverse=True)
        (i, j), root = np.split(at, 2), np.arange(len(nodes))
        while True:
            p, q = root[i], root[j]
            differ = p != q
            if not differ.any():
                return pa.table({"node": nodes, "root": nodes[root]})
            i, j = i[differ], j[differ]
            np.minimum.at(root, np.maximum(p, q)[differ], np.minimum(p, q)[differ])
            while (root[root] != root).any():
                root = root[root]

    found = inner.groupBy(F.pmod(F.xxhash64("_a"), F.lit(max(1, parts))).alias("_part")).applyInArrow(join_up, "node long, root long")
    if not outer.limit(1).count():
        return cut(found.withColumnRenamed("root", "component"))
    found = cut(found)
    of = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    between = outer.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    whole = cut(components(between).withColumnRenamed("node", "root"))
    out = found.join(whole, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    alone = whole.join(found.select(F.col("node").alias("root")), "root", "left_anti")
    return out.unionByName(alone.select(F.col("root").alias("node"), "component"))
