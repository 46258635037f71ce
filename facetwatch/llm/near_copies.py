"""Near copies: SimHash near-dedup for a stated similarity, Jaccard 0.8 on 5-word shingles.

Sets. A text is the set of its 5-word shingles, as 64-bit hashes (words and
hash as in ``simhash``). Equal sets are merged first, under a 64-bit hash of the
whole set, so exact copies cost nothing later.

Candidates. The anchors of ``simhash`` give the pairs within 2 fingerprint bits.
A 64-bit fingerprint cannot find the others: at Jaccard 0.8 two texts differ in
about ten bits and at times in seventeen, close to what strangers differ in. So
texts that may have a partner beyond 2 bits are told by MinHash bands: 32 bands
of 5 minima, of which a pair at Jaccard 0.8 shares two or more with a chance of
1 - 5e-5, and at 0.85 of 1 - 3e-7. A band only says which texts take part (those
that share two or more with any others); no band is ever gathered.

Links. Among the texts that take part, an exact similarity join finds every pair:
each set is ordered by how many of these texts have a shingle, rarest first. Of
a pair that is alike enough, the first shingle both have stands among the rarest
fifth of each, and what follows it must still be long enough in both. Texts that
share such a shingle are compared by exact Jaccard.

Hot shingles. A shingle that a third of all texts have does not make all pairs.
It first links its texts to one centre, the text with the fewest rarer shingles,
and is done if that leaves one component. Only where several are left, 16 texts,
then 256, 4096, ... meet those of other components, and all do once a group has no
more than that many. Groups are joined and counted,
never gathered, so adaptive execution can split them.

Defined cases: null text counts as empty; texts without words are copies of
each other; fewer words than a shingle give one shingle of all of them; rows
that repeat an id count as one document with several sets; rows with a null id
are kept, as are all rows that repeat the smallest id of a group; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwatch.llm.common import BROADCAST_IDS, claim, components, cut, fewer, release, settled, without
from facetwatch.llm.simhash import BLOCK, SEED, links, majority

BANDS, ROWS = 32, 5
_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64, endpoint=True)
_TIMES = _RNG.integers(0, 1 << 62, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 62, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """The shingle hashes of one text in order, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted different shingle hashes of one text."""
    return np.unique(shingle_hashes(text, size))


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key per band of a set of hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, BLOCK // 64)
    for at in range(0, len(h), step):
        np.minimum(low, ((h[None, at : at + step] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1), out=low)
    keys = (low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return keys ^ (keys >> np.uint64(29))


def _sets(docs: DataFrame, size: int, what: str) -> DataFrame:
    """Per row ``doc_id, sid, n, fp`` and the band ``keys`` or the shingle hashes (``grams``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near copies")
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                sids, ns, fps, lists = [], [], [], []
                for x in b.column(1):
                    every = shingle_hashes(x.as_py(), size)
                    h = np.unique(every)
                    sids.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                    ns.append(len(h))
                    fps.append(majority(every) if what == "keys" else 0)
                    lists.append(h if what == "grams" else band_keys(h) if len(h) else h)
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = pa.array(np.concatenate([*lists, np.zeros(0, np.uint64)]).view(np.int64))
                cols = [b.column(0), pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(ns, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sid", "n", "fp", what])
        release()

    return docs.mapInArrow(run, f"doc_id long, sid long, n long, fp long, {what} array<bigint>")


def _close(sets: DataFrame) -> DataFrame:
    """Pairs of sets whose fingerprints are within 2 bits, as spanning edges."""
    fps = sets.where("n > 0").groupBy("fp").agg(F.min("sid").alias("rep"))
    same = sets.where("n > 0").select("sid", "fp").join(fps, "fp").where("sid <> rep").select(F.col("rep").alias("a"), F.col("sid").alias("b"))
    return links(fps).unionByName(same).distinct()


def _prefixes(grams: DataFrame, least: float) -> DataFrame:
    """``h, sid, n, i, rep``: of each set the rarest shingles that a partner must share one of, and their places.

    ``h`` is the number of sets that have the shingle (65,535 at most) before 47 bits
    of its hash: one long that sorts by rarity.
    """
    each = grams.select("sid", F.explode("grams").alias("h"))
    known = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    rare = F.shiftleft(F.least("df", F.lit(65535)), 47).bitwiseOR(F.col("h").bitwiseAND(F.lit((1 << 47) - 1)))
    # Shingles of one text alone only move the others' places.
    met = each.join(known, "h").select("sid", rare.alias("h")).groupBy("sid").agg(F.array_sort(F.collect_list("h")).alias("at"))
    met = met.join(grams.select("sid", "n", "rep"), "sid").withColumn("alone", F.col("n") - F.size("at"))
    wanted = F.greatest(F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1 - F.col("alone"), F.lit(0)).cast("int")
    return met.select("sid", "n", "rep", "alone", F.posexplode(F.slice("at", F.lit(1), wanted)).alias("k", "h")).select("h", "sid", "n", (F.col("alone") + F.col("k")).alias("i"), "rep")


def _verified(pairs: DataFrame, grams: DataFrame, least: float, broadcast_rows: int) -> DataFrame:
    """Of pairs of sets ``(a, b)`` those that are alike enough by exact Jaccard, as pairs of documents.

    Up to ``broadcast_rows`` pairs are broadcast to the sets, so that only the sets of
    pairs move; beyond it sets and pairs are shuffled.
    """
    pairs = settled(pairs)
    asked = F.broadcast(pairs) if pairs.count() <= broadcast_rows else pairs
    a, b = (grams.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("grams").alias(f"g{x}"), F.col("rep").alias(f"r{x}")).join(asked, x) for x in "ab")
    both = F.size(F.array_intersect("ga", "gb"))
    return a.join(b, ["a", "b"]).where(both >= least * (F.col("na") + F.col("nb") - both) - 1e-9).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def _linked(grams: DataFrame, found: DataFrame, least: float, broadcast_rows: int) -> DataFrame:
    """``(node, component)`` of documents, by ``found`` and all other pairs of ``grams`` that are alike enough."""
    entries, before, wide = settled(_prefixes(grams, least)), 0, 1
    while True:
        groups = components(found)
        state = entries.join(groups.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).drop("rep")
        open_ = state.groupBy("h").agg(F.min(F.struct("i", "sid")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo < hi")
        state = settled(state.join(open_.select("h", F.col("c.sid").alias("centre"), "m"), "h"))
        most = state.agg(F.max("m")).first()[0]
        if most is None:
            return groups
        every = before > 0 and 16 * wide >= most
        draw = (F.xxhash64("sid") / 2.0**64 + 0.5) * F.col("m")  # each group's texts in an order of their own, from 0 to m
        if before == 0:
            x, y = state.where("sid = centre"), state
        elif every:
            x, y = state.where(draw >= before), state.where(draw >= before)
        else:
            x, y = state.where((draw >= before) & (draw < wide)), state.where(draw >= before)
        x = x.select("h", F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("comp").alias("cx"))
        y = y.select("h", F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("i").alias("iy"), F.col("comp").alias("cy"))
        needed = least / (1 + least) * (F.col("nx") + F.col("ny")) - 1e-9
        fits = (F.col("cx") != F.col("cy")) & (F.col("nx") - F.col("ix") >= needed) & (F.col("ny") - F.col("iy") >= needed)
        pairs = x.join(y, "h").where(fits & (F.col("x") < F.col("y")) if every else fits)
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = settled(found.unionByName(_verified(pairs, grams, least, broadcast_rows)))
        if every:
            return components(found)
        before, wide = (wide if before else 1e-300), 16 * wide


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """``(doc_id, component_id)`` of the documents with an id; ``component_id`` is the smallest id of the group."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    rows = cut(_sets(texts, size, "keys"))
    sets = cut(rows.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    close = settled(_close(sets))
    at = sets.select("sid", F.explode("keys").alias("key"))
    shared = at.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("key")
    members = at.join(shared, "key", "left_semi").groupBy("sid").agg(F.count("*").alias("bands")).where("bands > 1").select("sid")
    members = members.unionByName(close.select(F.explode(F.array("a", "b")).alias("sid"))).distinct()
    members = settled(members.join(sets.select("sid", "rep"), "sid"))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    wanted = F.broadcast(wanted) if members.count() <= broadcast_rows else wanted
    grams = _sets(texts.join(wanted, "doc_id", "left_semi"), size, "grams").join(members, "sid")
    grams = cut(grams.dropDuplicates(["sid"]).select("sid", "n", "rep", "grams"))
    grams = fewer(grams, (grams.agg(F.sum("n")).first()[0] or 0) // 2)
    groups = _linked(grams, settled(_verified(close, grams, least, broadcast_rows)), least, broadcast_rows).withColumnRenamed("node", "rep")
    named = sets.select("sid", "rep").join(groups, "rep", "left").select("sid", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", "sid").join(named, "sid").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that bear the smallest id of their group, and those without an id; columns unchanged."""
    lost = near_copies(docs, id_col, text_col, size, least).where("doc_id <> component_id").select(F.col("doc_id").alias("__lost")).distinct()
    return without(docs, lost, docs[id_col].cast("long") == F.col("__lost"))
