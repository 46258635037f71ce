"""Token counts: pieces are counted once per distinct pre-token.

One pass turns blocks of documents into rows ``(pre-token, documents of the
block with their frequencies)``. These rows are shuffled by pre-token, so that
every pre-token meets all its frequencies in one place; there the library
counts its pieces once, and the counts are joined to the frequencies and summed
per document. No token ids are kept. A pre-token with over ``WIDE`` postings in a
block is salted there by a hash of task and block, with as many salts as there are
shuffle partitions. So the postings of a frequent word are spread over all of
these, and its pieces are counted once for each salt.

Pre-tokens. The tokenizer drops white space and lower-cases, and its pieces
never span white space. So any white-space-delimited stretch of a text can be
counted alone. Texts of Latin letters are cut further, at the tokenizer's own
word, digit and punctuation borders, which makes pre-tokens fewer. Texts with
characters for which that could differ (combining marks, special strings) keep
the coarser stretches, and the library sees these as they are.

Defined cases: null text counts as empty (0 bytes, 0 tokens); rows that repeat
an id are counted each; null ids stay null; a very long text is cut into
blocks' worth of pre-tokens without being copied; an empty table gives an empty
result; other columns are ignored. The input should be a stored table: a lost
task is then read again in the same order.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwatch.llm.common import claim

#: White space of the tokenizer below U+0180, and its word pattern there.
_SPACE = "\t-\r \x85\xa0"
_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-įı-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
_OTHER = re.compile("[^\x00-įı-ſ]")
_GAP, _CONTROL = re.compile(f"[{_SPACE}]+"), re.compile("[\x1c-\x1f]")
#: (document, frequency) pairs that make a block.
BLOCK_PAIRS = 2_000_000
#: Postings in a block above which a pre-token is salted.
WIDE = 64


def model(path: str):
    """The tokenizer of a file, loaded once per Python worker and dropped when an operator without one claims the worker."""
    _models = claim("tokens")
    if path not in _models:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _models[path] = t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
    return _models[path]


def stretches(text: str) -> list[str]:
    """Parts of a text between white space, in lower case where that cannot change the result."""
    if _OTHER.search(text) or "<|" in text:
        return [x.decode("utf-8", "surrogatepass") for x in text.encode("utf-8", "surrogatepass").split()]
    return _GAP.split(text.lower()) if _CONTROL.search(text) else text.lower().split()


def pre_tokens(text: str) -> list[str]:
    """Parts of a text that the lower-casing word tokenizer encodes independently of each other."""
    if _OTHER.search(text) or "<|" in text:
        return [x.decode("utf-8", "surrogatepass") for x in text.encode("utf-8", "surrogatepass").split()]
    return _PLAIN.findall(text.lower())


def count_pieces(path: str, parts: list[str]) -> np.ndarray:
    """Number of pieces of each string."""
    return np.fromiter((len(e.ids) for e in model(path).encode_batch_fast(parts, add_special_tokens=False)), np.int64, len(parts))


def salt_of(base: int, salts: int) -> int:
    """The salt, from 1 on, that wide pre-tokens of a block get; ``base`` tells the task and the block."""
    return zlib.crc32(base.to_bytes(8, "little")) % salts + 1


def _block(base: int, salts: int, docs: list[tuple[int | None, int]], names: dict[str, int], ids: list, codes: list) -> Iterator[pa.RecordBatch]:
    """Rows of one block: its documents, then its pre-tokens with packed postings."""
    schema = pa.schema([("token", pa.string()), ("salt", pa.int64()), ("base", pa.int64()), ("codes", pa.list_(pa.int32())), ("doc_id", pa.int64()), ("n_bytes", pa.int64())])
    n = len(docs)
    if n:
        own = [pa.nulls(n, pa.string()), pa.array(base + np.arange(n)), pa.array(base + np.arange(n)), pa.nulls(n, pa.list_(pa.int32())), pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.int64())]
        yield pa.RecordBatch.from_arrays(own, schema=schema)
    if not names:
        return
    ids, codes = np.concatenate(ids), np.concatenate(codes)
    order = np.argsort(ids, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(names)))]).astype(np.int32)
    codes, tokens, wide = codes[order], list(names), np.diff(ends) > WIDE
    salt = np.where(wide, salt_of(base, salts), 0)
    for lo in range(0, len(tokens), 50_000):
        hi = min(len(tokens), lo + 50_000)
        lists = pa.ListArray.from_arrays(pa.array(ends[lo : hi + 1] - ends[lo]), pa.array(codes[ends[lo] : ends[hi]]))
        m = hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(tokens[lo:hi]), pa.array(salt[lo:hi]), pa.array(np.full(m, base)), lists, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], schema=schema)


def _frequencies(split, block_pairs: int, salts: int):
    """Maps documents to block rows; a posting is the document's place in its block, times 64, plus a frequency below 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        docs, names, ids, codes, pairs = [], {}, [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                found = Counter(split(text))
                at, k = len(docs), len(found)
                docs.append((doc_id, len(text.encode("utf-8", "surrogatepass"))))
                if k:
                    put = names.setdefault
                    ids.append(np.fromiter((put(t, len(names)) for t in found), np.int64, k))
                    freq = np.fromiter(found.values(), np.int64, k)
                    codes.append((at << 6 | np.minimum(freq, 63)).astype(np.int32))
                    which, freq = ids[-1], freq - 63
                    while (big := freq > 0).any():  # the rest of large frequencies, in further postings
                        which, freq = which[big], freq[big]
                        ids.append(which)
                        codes.append((at << 6 | np.minimum(freq, 63)).astype(np.int32))
                        freq = freq - 63
                    pairs += k
                if pairs >= block_pairs or len(docs) >= 1 << 20:
                    yield from _block(base, salts, docs, names, ids, codes)
                    base += 1 << 20
                    docs, names, ids, codes, pairs = [], {}, [], [], 0
        yield from _block(base, salts, docs, names, ids, codes)

    return run


def _sums(path: str):
    """At the home of each pre-token: pieces once, times frequencies, summed per document of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
        for b in batches:
            token = b.column(0)
            own = b.filter(token.is_null())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(2), own.column(4), own.column(5), pa.array(np.zeros(own.num_rows, np.int64))], schema=schema)
            rest = b.filter(token.is_valid())
            if not rest.num_rows:
                continue
            tokens = rest.column(0).to_pylist()
            new = list({t for t in tokens if t not in known})
            if len(known) + len(new) > 1_000_000:
                known, new = {}, list(set(tokens))
            known.update(zip(new, count_pieces(path, new).tolist(), strict=True))
            each = np.fromiter((known[t] for t in tokens), np.int64, len(tokens))
            codes = rest.column(3).flatten().to_numpy()
            times = np.diff(rest.column(3).offsets.to_numpy())
            rows = np.repeat(rest.column(2).to_numpy(), times) + (codes >> 6)
            rows, back = np.unique(rows, return_inverse=True)
            n = np.bincount(back, weights=(codes & 63) * np.repeat(each, times), minlength=len(rows)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(n)], schema=schema)

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``path`` is a tokenizer file that every executor can open. A ``.json`` file
    must lower-case and drop white space; with a ``.model`` file, whose pieces
    may span words, each whole text is its own pre-token.
    """
    if path.endswith(".model"):

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [x or "" for x in b.column(1).to_pylist()]
                new = list(dict.fromkeys(texts))
                known = dict(zip(new, map(len, model(path).encode(new, num_threads=1)), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([known[t] for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(whole, "doc_id long, n_bytes long, n_tokens long")
        return out.withColumn("over_limit", F.col("n_tokens") > limit)
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    rows = rows.mapInArrow(_frequencies(pre_tokens, block_pairs, salts), "token string, salt long, base long, codes array<int>, doc_id long, n_bytes long")
    rows = rows.repartition("token", "salt")
    rows = rows.mapInArrow(_sums(path), "row long, doc_id long, n_bytes long, n_tokens long")
    rows = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
