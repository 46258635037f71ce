"""Exact dedup: 128-bit content hash groups, bytes compared inside each group.

Plan. Every row gets ``md5(normalised text)``. A grouping by hash alone counts rows
and takes the smallest id. Only hashes of two rows or more can have copies; their
rows are grouped by ``(hash, text)`` with map-side combining, so a group of copies,
however large, leaves each map task as a single row, and the byte comparison of
the texts under one hash is the grouping itself. It tells hashes with one text
from hashes with several (collisions). Hashes of several rows are broadcast below a
checked number; beyond it all rows go through that second grouping, and every
different text is shuffled once. Rows then look up their group by hash alone; only
rows under a collided hash carry their text into the lookup. Hot hashes in that
lookup are split by adaptive skew-join handling: nothing above it needs rows of a
key together.

Defined cases: null text counts as empty; empty texts are equal to each other;
a null id sorts after all others and its row is kept only where every id of
its group is null; rows that repeat an id and a text share the keeper id, and
all rows that bear the keeper id are marked kept; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetwatch.llm.common import BROADCAST_IDS, cut

#: Fixed value: the white space that equality ignores.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty; every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=lambda text: F.unhex(F.md5(text)), broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``content_hash`` maps the normalised text column to its 128-bit hash; it is
    a parameter so that tests can force collisions.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("h", content_hash("norm"))
    hashes = cut(rows.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    several = hashes.where("group_size > 1").select("h")
    few = several.count() <= broadcast_rows
    texts = (rows.join(F.broadcast(several), "h", "left_semi") if few else rows).groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Collisions: hashes under which bytes differ.
    collided = cut(texts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    out = rows.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")).join(hashes, "h")
    if collided.isEmpty():
        out = out.drop("h")
    else:
        out = out.join(collided, "h", "left_anti").drop("h")
        apart = rows.join(collided, "h", "left_semi").join(texts.join(collided, "h", "left_semi"), ["h", "norm"])
        out = out.unionByName(apart.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
