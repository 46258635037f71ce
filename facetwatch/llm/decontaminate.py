"""Benchmark decontamination: size-partitioned MinHash containment search, native.

Texts become lower-case words (runs of letters and digits) and shingles of five
words. A benchmark item leaks into a document when at least ``similarity`` of
the item's different shingles stand in it (containment, not Jaccard: documents
are thousands of times longer than items, so that equal-length MinHash
signatures of both would hardly ever agree).

Size partitions. Items are partitioned by their shingle count, in steps of a
quarter, and each partition has its own signature length, from its largest item:
with containment c of q shingles at most floor((1 - c) q) are missing, so among
the smallest floor((1 - c) q) + 1 MinHash values of the item at least one is in
every document that contains it. The signature of an item is those smallest
values. Each partition has its own threshold, its largest signature value; a
document's sketch for it is its hashes up to there (a scaled MinHash). One shared
value makes a candidate. No leak is lost. ``pass_rates`` tells the thresholds.

Search. A document's hashes up to the largest threshold are looked up while the
row streams by, once for all partitions: a value belongs to the partitions whose
signatures hold it. The look-up has the bare values, and is broadcast only below a
checked count; above it, hashes and values meet in a shuffled join whose hot keys
adaptive execution splits. The few values found are joined to their items, and
each (document, item) is kept once before any text is compared.

Verification is exact: candidates fetch their texts by id, each of the item's
shingles is searched as text in the document's words, and the share found is compared with ``similarity``.

Defined cases: null and empty texts, and items without words, match nothing;
items of fewer words than a shingle are one shingle of all their words; items and
documents with a null id are matched like others; equal
pairs from repeated rows are merged, the largest containment stays; an empty
benchmark or table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetwatch.llm.common import cut, without

#: Signature values (8 bytes) and candidates (24 bytes) up to which these tables are broadcast.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case words parted by single spaces, with none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _hash(n: int, words: Column) -> Column:
    """Hash of the first ``n`` words of an array."""
    return F.xxhash64(*(F.get(words, F.lit(k)) for k in range(n)))


def _items(items: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``key, item_id, n, shingles, need, part`` of the different items with words (``n``: words in a shingle)."""
    w = items.select(F.col(id_col).cast("long").alias("item_id"), words_of(F.col(text_col)).alias("norm")).where("norm <> ''").distinct()
    w = w.withColumn("words", F.split("norm", " ")).withColumn("n", F.least(F.size("words"), F.lit(shingle)))
    at = F.sequence(F.lit(0), F.size("words") - F.col("n"))
    w = w.withColumn("shingles", F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("words", i + 1, F.col("n")), " "))))
    q = F.size("shingles")
    return w.select(F.xxhash64("norm", "item_id").alias("key"), "item_id", "n", "shingles", F.ceil(q * similarity - 1e-9).cast("int").alias("need"), F.floor(F.log(1.25, q)).alias("part"))


def signatures(items: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Per signature value ``h, key, n, part`` of the items."""
    top = items.groupBy("part").agg((F.floor(F.max(F.size("shingles")) * (1 - similarity) + 1e-9) + 1).cast("int").alias("length"))
    w = items.join(F.broadcast(top), "part")  # one row for each step of a quarter: at most 97
    pieces = F.transform("shingles", lambda s: F.split(s, " "))
    hashes = F.lit(None).cast("array<long>")
    for n in range(1, shingle + 1):
        hashes = F.when(F.col("n") == n, F.transform(pieces, partial(_hash, n))).otherwise(hashes)
    return w.select("key", "n", "part", F.explode(F.slice(F.array_sort(F.array_distinct(hashes)), F.lit(1), F.col("length"))).alias("h"))


def pass_rates(items: DataFrame, item_col: str = "item_id", item_text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per partition its number of signature values, and the share of all hashes that are up to its threshold."""
    sig = signatures(_items(items, item_col, item_text, shingle, similarity), similarity, shingle)
    return sig.groupBy("part").agg(F.count("*").alias("n_values"), (F.max("h") / 2.0**64 + 0.5).alias("pass_rate"))


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    shingle: int = 5, similarity: float = 0.8, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, text_key, item_id, n_shingles, n_shared, containment`` for every leak.

    ``text_key`` tells rows that share an id apart.
    """
    whole = cut(_items(items, item_col, item_text, shingle, similarity))
    sig = cut(signatures(whole, similarity, shingle))
    top, *has = sig.agg(F.max("h"), *(F.max((F.col("n") == n).cast("int")) for n in range(1, shingle + 1))).first()
    lengths = [n for n, x in enumerate(has, 1) if x] or [shingle]
    values = cut(sig.select("h").distinct())
    values = F.broadcast(values) if values.count() <= broadcast_rows else values
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    words = texts.select("doc_id", "text_key", F.split(words_of(F.col("text")), " ").alias("words"))
    # Places are exploded, not hashes, so that hashing is compiled with what follows it.
    places = words.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("i"))
    hashes = [F.when(F.col("i") + n <= F.size("words"), F.xxhash64(*(F.col("words")[F.col("i") + k] for k in range(n)))) for n in lengths]
    seen = places.select("doc_id", "text_key", hashes[0].alias("h")) if len(lengths) == 1 else places.select("doc_id", "text_key", F.explode(F.array(*hashes)).alias("h"))
    hits = seen.where(F.col("h") <= F.lit(top)).join(values, "h", "left_semi").distinct()
    found = cut(hits.join(sig.select("h", "key"), "h").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "key").distinct())
    found = F.broadcast(found) if found.count() <= broadcast_rows else found
    pairs = texts.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")))
    pairs = pairs.select("doc_id", "text_key", "key", F.concat(F.lit(" "), words_of(F.col("text")), F.lit(" ")).alias("padded")).join(whole, "key")
    shared = F.size(F.filter("shingles", lambda s: F.contains("padded", F.concat(F.lit(" "), s, F.lit(" ")))))
    pairs = pairs.select("doc_id", "text_key", "item_id", "need", F.size("shingles").alias("n_shingles"), shared.alias("n_shared"))
    pairs = pairs.where("n_shared >= need").withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return pairs.groupBy("doc_id", "text_key", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"), F.max("containment").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item; columns unchanged."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = leaks(docs, items, **options).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return without(docs, bad, docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__key")))
