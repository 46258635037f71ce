"""SimHash near-dedup by anchor-point covering.

Fingerprints. A text's words are joined into shingles, each shingle is hashed
with XXH64, and a bit of the 64-bit fingerprint is set where more than half of
the shingle hashes have it set. This is one pass without a shuffle; hashes are
summed bit by bit in blocks, so a very long text needs bounded memory.

Anchors. The anchors are a covering code of the 64-bit space: the perfect
[63, 57] Hamming code on bits 0..62, covering radius 1, times the one-bit code
of all words on bit 63, covering radius 0. Two fingerprints within the
threshold t = 2 have a midpoint within 1 of both, and the midpoint has an
anchor within the covering radius. So each fingerprint is replicated to every
anchor within the covering radius plus its half of the threshold on each side:
a pair meets at an anchor, and no pair is lost. This is the symmetric form of
replicating one side to the covering radius and the other to radius plus the
whole threshold, with 33 replicas in place of over 600.

The anchors that get a fingerprint follow from its Hamming syndrome by a fixed
table of 64 x 33 masks, so replication is one generated JVM expression.

Comparison per anchor. The code bounds the number of different fingerprints at
an anchor (all lie within 2 of it: 2,081 at most) whatever the data are, so no
anchor can become hot; equal fingerprints were merged before. Each anchor
links what it holds into local components and emits one edge per member, never
all pairs. The components of those edges are the answer.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and links like any other; fewer words than a shingle give one shingle of
all of them; rows that repeat an id count as one document per fingerprint they
have; null ids get a fingerprint but take no part in components unless equal
ids exist; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwatch.llm.common import components, cut

#: Fixed values of the fingerprint: what parts words, and the hash seed.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Shingle hashes that are summed at a time.
BLOCK = 1 << 15


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _bits(ones: np.ndarray, n: int) -> int:
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def majority(h: np.ndarray) -> int:
    """The fingerprint of a text from all its shingle hashes; 0 without any."""
    return _bits(sum((bit_sums(h[at : at + BLOCK]) for at in range(0, len(h), BLOCK)), np.zeros(64, np.int64)), len(h)) if len(h) else 0


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    # bytes.lower() and bytes.split() touch ASCII only; split() parts at \x20 and \x09-\x0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + shingle - 1] if n > 1 else words
        if n > 1:
            grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        else:
            grams = iter([b" ".join(part)])
        ones += bit_sums(np.fromiter((digest(g, SEED) for g in grams), np.uint64))
    return _bits(ones, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with ``fp`` the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


def anchor_masks() -> list[list[int]]:
    """For each Hamming syndrome of bits 0..62: what to flip to reach the anchors in reach.

    Bit p of a fingerprint has position p + 1 in the code; a word's syndrome is
    the xor of the positions of its set bits; flipping positions whose xor is
    the syndrome gives a code word. In reach: at most two flips on bits 0..62,
    or at most one of these together with bit 63.
    """
    top = -(1 << 63)
    out = []
    for s in range(64):
        near = [0] if s == 0 else [1 << (s - 1)]
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 64) if s and i < (i ^ s) and i != s]
        out.append(near + pairs + [m | top for m in near])
    return out


def anchors_within(reach: int) -> list[tuple[int, int]]:
    """``(syndrome, mask)`` of all anchors within ``reach`` flips, for wider thresholds than two."""
    out = []
    for n in range(reach + 1):
        for at in combinations(range(1, 64), n):
            s = mask = 0
            for i in at:
                s, mask = s ^ i, mask | 1 << (i - 1)
            out.append((s, mask))
            if n < reach:
                out.append((s, mask | -(1 << 63)))
    return out


def at_anchors(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Replicates ``fps(rep, fp)`` to ``(anchor, rep, fp)``."""
    checks = [sum(1 << p for p in range(63) if (p + 1) >> k & 1) for k in range(6)]
    syndrome = sum((F.bit_count(F.col("fp").bitwiseAND(F.lit(c).cast("long"))) % 2 * (1 << k) for k, c in enumerate(checks)), F.lit(0))
    if threshold > 2:
        reach = 1 + (threshold + 1) // 2
        masks = fps.sparkSession.createDataFrame(anchors_within(reach), "s int, mask long")
        met = fps.withColumn("s", syndrome.cast("int")).join(F.broadcast(masks), "s")  # 640,000 masks at most
        return met.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("anchor"), "rep", "fp")
    table = "array(" + ", ".join("array(" + ", ".join("-9223372036854775808L" if m == -(1 << 63) else f"{m}L" for m in row) + ")" for row in anchor_masks()) + ")"
    table = table.replace("-9223372036854775808L", "cast('-9223372036854775808' as bigint)")
    masks = F.element_at(F.expr(table), syndrome.cast("int") + 1)
    return fps.select("rep", "fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("anchor"), "rep", "fp")


def _local_edges(reps: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the smallest member of its component at one anchor."""
    order = np.argsort(reps, kind="stable")
    reps, fps = reps[order], fps[order]
    root = np.full(len(reps), -1)
    for i in range(len(reps)):
        if root[i] >= 0:
            continue
        root[i], wave = i, [i]
        while wave:
            k = wave.pop()
            free = np.flatnonzero(root < 0)
            hit = free[np.bitwise_count(fps[free] ^ fps[k]) <= threshold]
            root[hit] = i
            wave.extend(hit.tolist())
    off = np.flatnonzero(root != np.arange(len(reps)))
    return reps[off], reps[root[off]]


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Spanning edges ``(a, b)`` between the representatives of linked fingerprints.

    ``fps`` has one row ``(rep, fp)`` per different fingerprint. Thresholds of 3 or 4
    reach some 700 anchors, 5 or 6 some 10,000; beyond that replication is no method.
    """
    if threshold > 6:
        raise ValueError("anchors multiply too fast for thresholds above 6")
    held = at_anchors(fps, threshold).groupBy("anchor").agg(F.collect_list(F.struct("rep", "fp")).alias("at"), F.count("*").alias("n"))
    held = held.where("n > 1").select(F.col("at.rep").alias("rep"), F.col("at.fp").alias("fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, a, z = b.column(0).offsets.to_numpy(), [], []
            reps, fps = b.column(0).values.to_numpy(), b.column(1).values.to_numpy().view(np.uint64)
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                x, y = _local_edges(reps[lo:hi], fps[lo:hi], threshold)
                a.append(x)
                z.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(z))], ["a", "b"])

    return held.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """Per input row ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id reachable over links, the row's own included.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    # Fingerprints are the nodes, so that an id with several texts joins nothing; then each component has its smallest id.
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = reps.where("least is not null").select(F.col("fp").alias("rep"), "fp")
    found = components(links(known, threshold)).withColumnRenamed("node", "fp")
    named = cut(reps.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 2) -> DataFrame:
    """The rows of ``docs`` that bear the smallest id of their component; columns unchanged.

    Rows with a null id are kept.
    """
    lost = simhash_components(docs, id_col, text_col, shingle, threshold).where("doc_id <> component_id").select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, docs[id_col].cast("long") == lost["__lost"], "left_anti")
