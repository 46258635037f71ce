"""Line dedup by distinct-site spread, native.

A line that stands on ``min_sites`` or more different sites is boilerplate. It
stays in the document with the smallest id that has it and goes from all others,
so no wording is lost from the corpus.

Lines are told apart by 128 bits (two hashes).

Spread. One aggregation per line hash builds a HyperLogLog sketch of the sites
with map-side combining: a line that a third of all rows share arrives as one
sketch per map task. Estimates clearly above or below the threshold decide;
lines within the sketch's error of it (four standard errors, at least one site)
get an exact distinct count over (line, site) pairs that are merged before they
are shuffled. Removal looks line hashes up again: the table of boilerplate
lines is broadcast only below a checked row count, else joined by shuffle with
hot lines split. Only positions of removed lines travel to the documents: they are
broadcast below a checked number of them, else documents are shuffled to them.

Defined cases: lines are parted by line feeds and compared with white space at
the ends cut off; lines shorter than ``min_chars`` are never boilerplate; null
text has no lines and stays null; null sites count as one site; rows whose ids
are all null keep their lines; rows that repeat an id are told apart by text,
and those with the keeper's id keep the line; repeats of a line inside the
keeper stay; an empty table gives an empty result; other columns pass through
``line_dedup`` unchanged, but for columns named ``n_lines`` and ``n_removed``, which
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetwatch.llm.common import cut

#: Rows up to which the boilerplate lines (24 bytes each) and the positions to remove (20 bytes) are broadcast.
BROADCAST_ROWS = 500_000


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.coalesce(F.xxhash64(F.col(site_col).cast("string")), F.lit(0)).alias("site"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"),
    )
    rows = rows.withColumn("line", _bare(F.col("line"))).where(F.char_length("line") >= min_chars)
    return rows.select("doc_id", "key", "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 3, min_chars: int = 16, lg_k: int = 10, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(h, g, first_doc)`` of the lines on at least ``min_sites`` sites."""
    lines = _lines(docs, id_col, text_col, site_col, min_chars)
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min("doc_id").alias("first_doc"))
    error = max(1, round(4 * 1.04 / (1 << lg_k) ** 0.5 * min_sites))
    spread = cut(spread.where(F.col("sites") >= min_sites - error))
    near = spread.where(F.col("sites") <= min_sites + error)
    # Either way a line leaves a map task once per site at most, however often it stands there.
    if near.count() <= broadcast_rows:
        pairs = lines.join(F.broadcast(near.select("h", "g")), ["h", "g"], "left_semi").select("h", "g", "site").distinct()
    else:
        pairs = lines.select("h", "g", "site").distinct().join(near.select("h", "g"), ["h", "g"], "left_semi")
    exact = pairs.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    sure = spread.where(F.col("sites") > min_sites + error).select("h", "g", "first_doc")
    return sure.unionByName(near.join(exact, ["h", "g"]).select("h", "g", "first_doc"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 3, min_chars: int = 16, lg_k: int = 10, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, and columns ``n_lines, n_removed`` added."""
    found = cut(boilerplate(docs, id_col, text_col, site_col, min_sites, min_chars, lg_k, broadcast_rows))
    found = F.broadcast(found) if found.count() <= broadcast_rows else found
    hits = _lines(docs, id_col, text_col, site_col, min_chars).join(found, ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    hits = cut(hits.select("doc_id", "key", "pos").distinct())
    few = hits.count() <= broadcast_rows
    hits = hits.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("__gone"))
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "__gone")
    hits = F.broadcast(hits) if few else hits
    rows = docs.withColumn("__text", F.xxhash64(text_col))
    both = rows.join(hits, rows[id_col].cast("long").eqNullSafe(hits["__id"]) & (rows["__text"] == hits["__key"]), "left")
    parts = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    both = both.withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0))).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)))
    both = both.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines"))).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
    return both.withColumn(text_col, F.when(F.col("n_removed") > 0, kept).otherwise(F.col(text_col))).drop("__text", "__id", "__key", "__gone")
