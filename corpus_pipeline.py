"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet in
the shared folder and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``; further columns of their table pass through
the stages, whatever their names.

Near-dedup. The stage keeps one document of each group that is linked by a Jaccard
similarity of 0.8 on 5-word shingles. SimHash anchors find those within 2 bits and
an exact similarity join the rest; see ``facetwatch.llm.near_copies``.

Defined cases: rows with null or empty text, or without a letter, go in the first
stage; rows with a null id are kept by all stages and packed; rows that repeat an
id are judged each, and near-dedup keeps all that bear the smallest id of their
group; of equal texts the smallest id stays, of tied languages the first in order;
``n_chars`` follows the text where lines went; an empty table passes as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwatch.llm.common import remove, scratch, table
from facetwatch.llm.decontaminate import decontaminate
from facetwatch.llm.language import identify
from facetwatch.llm.line_dedup import line_dedup
from facetwatch.llm.near_copies import drop_near_copies
from facetwatch.llm.packing import pack
from facetwatch.llm.registry import vocabulary


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no language with half of the text."""
    return _only(docs, identify(docs).where("lang_pred <> 'und' and score >= 0.5"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines; documents that lose every line go, others keep what is left."""
    rows = line_dedup(docs).where("n_removed = 0 or trim(text) <> ''")
    return _only(docs, rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (Jaccard 0.8 on 5-word shingles)."""
    return _only(docs, drop_near_copies(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return _only(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row per piece."""
    rows = pack(docs, vocabulary(), cache=60_000)  # the stages before it leave little memory
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


STAGES = [("languages", languages), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing)]

#: Packing and language ID are not expressible in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
