"""Packing: vector bin packing by the dot-product heuristic.

Every example is a piece of a tokenized document, a vector of three demands:
tokens, segments (one) and loss-bearing tokens. A sequence is a bin with a limit
in each dimension. Documents of a full sequence or more give off full pieces at
once; what is left waits in a window. A bin is filled when the window is large
enough and what waits reaches one of the limits; so the window holds less than
``max_segments`` pieces or ``window``, whichever is more. An open bin takes, among the
waiting pieces that fit all three remaining capacities, the one with the
largest dot product of its demands and the remaining capacities, both relative
to the limits. When none fits, the piece with the largest dot product is cut to
what is left of the bin, and its rest waits on. A sequence that is not full, because
the segment or loss limit was reached or the partition ends, is cut to the largest power
of two in it and needs no padding; what is cut off waits on.

Scale. Packing happens where the text is read: no shuffle, no group, no state
beyond the window. The only cost of packing partitions apart is their tails,
and these carry no padding. Sequence ids hold the partition in their high bits.
The input should be a stored table: a lost task is then read again alike.

Tokens. White-space-delimited stretches of text are encoded once per worker
and kept in a bounded two-generation cache; a document's ids are their
concatenation, which equals the library's own result (see ``tokens``).

Defined cases: null text counts as empty and gives the end token alone; rows
that repeat an id are packed each; null ids stay null; very long documents are
cut into many pieces; an empty table gives an empty result; other columns are
ignored; null ``loss_start`` counts as 0 and is held to the document's length, and a
null prompt is empty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwatch.llm.common import claim
from facetwatch.llm.tokens import model, stretches

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, loss_tokens long, ids binary"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    #: Parts stretches within an encode call; a stretch that holds it is encoded alone.
    MARK = "\x01"

    def __init__(self, path: str, keep: int = 600_000):
        self.path, self.keep, self.young, self.old = path, keep, {}, {}
        marks = model(path).encode(self.MARK, add_special_tokens=False).ids
        self.mark = marks[0] if len(marks) == 1 else None

    def _learn(self, parts: set[str]) -> None:
        """Puts unknown stretches into the cache: from its old generation, or encoded, many in one call."""
        young, old, plain, odd = self.young, self.old, [], []
        for p in parts:
            if (ids := old.get(p)) is not None:
                young[p] = ids
            else:
                (odd if self.mark is None or self.MARK in p or "<|" in p else plain).append(p)
        packs = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        between = f" {self.MARK} "
        for pack, e in zip(packs, model(self.path).encode_batch_fast([between.join(x) for x in packs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark).tolist()
            raw = ids.tobytes()
            young.update((p, raw[4 * a + 4 : 4 * z]) for p, a, z in zip(pack, [-1, *ends], [*ends, len(ids)], strict=True))
        for p, e in zip(odd, model(self.path).encode_batch_fast(odd, add_special_tokens=False), strict=True):
            young[p] = np.array(e.ids, "<u4").tobytes()

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        words = [stretches(t or "") for t in texts]
        get = self.young.get
        found = [list(map(get, w)) for w in words]
        self._learn({x for w, f in zip(words, found, strict=True) for x, ids in zip(w, f, strict=True) if ids is None})
        for w, f in zip(words, found, strict=True):
            yield b"".join([get(x) if ids is None else ids for x, ids in zip(w, f, strict=True)])


def encoder(path: str, keep: int) -> Encoder:
    """One encoder per Python worker, so its cache serves all tasks there."""
    kept = claim("tokens")  # with the model that it uses
    if (path, keep) not in kept:
        kept[path, keep] = Encoder(path, keep)
    return kept[path, keep]


class Packer:
    """Fills sequences from a stream of pieces; yields finished ones.

    A piece is ``[doc_id, start, ids, doc_tokens, loss_start]``.
    """

    def __init__(self, tokens: int, segments: int, loss: int, window: int):
        self.limit = np.array([tokens, segments, loss], float)
        self.window, self.pieces = window, []
        self.need = np.zeros((0, 3))

    @staticmethod
    def _loss(piece: list) -> int:
        start, n = piece[1], len(piece[2]) // 4
        return max(0, start + n - max(start, piece[4]))

    def _put(self, piece: list) -> None:
        self.pieces.append(piece)
        self.need = np.vstack([self.need, [len(piece[2]) // 4, 1, self._loss(piece)]])

    def _split(self, piece: list, n: int) -> tuple[list, list]:
        a, b = list(piece), list(piece)
        a[2], b[2], b[1] = piece[2][: 4 * n], piece[2][4 * n :], piece[1] + n
        return a, b

    def _longest(self, piece: list, left: np.ndarray) -> int:
        """Most leading tokens of a piece that the remaining capacities take."""
        free = max(0, piece[4] - piece[1])  # leading tokens that bear no loss
        return int(min(len(piece[2]) // 4, left[0], free + left[2])) if left[1] >= 1 else 0

    def _fill(self, cap: np.ndarray) -> list[list]:
        """Takes one bin of capacity ``cap`` out of the window."""
        taken, left, off = [], cap.copy(), np.zeros(len(self.pieces), bool)
        while left[0] >= 1 and left[1] >= 1 and not off.all():
            score = np.where(off, -1.0, (self.need / self.limit) @ (left / self.limit))
            fits = (self.need <= left).all(axis=1) & ~off
            k = int(np.argmax(np.where(fits, score, -1.0) if fits.any() else score))
            if not fits[k]:
                n = self._longest(self.pieces[k], left)
                if n < 1:
                    break
                piece, rest = self._split(self.pieces[k], n)
                self.pieces[k] = rest
                self.need[k] = [len(rest[2]) // 4, 1, self._loss(rest)]
            else:
                piece, off[k] = self.pieces[k], True
            taken.append(piece)
            left -= [len(piece[2]) // 4, 1, self._loss(piece)]
        if off.any():
            self.pieces = [p for p, gone in zip(self.pieces, off, strict=True) if not gone]
            self.need = self.need[~off]
        return self._trimmed(taken)

    def _even(self, n: int) -> int:
        """The tokens of a sequence that can hold ``n``: all, or the largest power of two."""
        return n if n >= self.limit[0] else 1 << (n.bit_length() - 1)

    def _trimmed(self, taken: list[list]) -> list[list]:
        """The pieces of a sequence of even size; the rest goes back to the window."""
        room = self._even(sum(len(p[2]) // 4 for p in taken))
        kept = []
        for piece in taken:
            n = len(piece[2]) // 4
            if n > room:
                rest = piece
                if room:
                    head, rest = self._split(piece, room)
                    kept.append(head)
                self._put(rest)
                room = 0
            else:
                kept.append(piece)
                room -= n
        return kept

    def add(self, piece: list) -> Iterator[list[list]]:
        while len(piece[2]) // 4 >= self.limit[0]:
            n = self._even(self._longest(piece, self.limit))
            head, piece = self._split(piece, n)
            yield [head]
        if piece[2]:
            self._put(piece)
        while len(self.pieces) >= self.window and (self.need.sum(axis=0) >= self.limit).any():
            yield self._fill(self.limit)

    def finish(self) -> Iterator[list[list]]:
        while self.pieces:
            total = int(self.need[:, 0].sum())
            if total < self.limit[0]:  # a tail: the largest power of two it can fill
                cap = self.limit.copy()
                cap[0] = 1 << (total.bit_length() - 1)
                yield self._fill(cap)
            else:
                yield self._fill(self.limit)


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", loss_start_col: str | None = None, prompt_col: str | None = None,
    max_tokens: int = 4096, max_segments: int = 1024, max_loss: int = 4096, end_id: int = 2, window: int = 256, cache: int = 600_000,
) -> DataFrame:
    """One row per piece, with its ids; see ``SCHEMA``.

    ``prompt_col`` names the prompt of an instruction example: its tokens go
    before those of the text and bear no loss. ``loss_start_col`` tells instead
    how many leading tokens of the text bear none. ``path`` is a tokenizer file
    that every executor can open. A Python worker keeps the ids of up to twice
    ``cache`` stretches of text, about 200 bytes each.
    """
    if max_tokens < 1 or max_segments < 1 or max_loss < 1 or window < 1:
        raise ValueError("limits and window must be positive")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path, cache), Packer(max_tokens, max_segments, max_loss, window)
        sequence, rows = TaskContext.get().partitionId() << 40, []

        def finished(bins: Iterator[list[list]]) -> None:
            nonlocal sequence
            for pieces in bins:
                at, total = 0, sum(len(p[2]) // 4 for p in pieces)
                for p in pieces:
                    n = len(p[2]) // 4
                    rows.append((p[0], p[1], n, p[3], sequence, at, total, packer._loss(p), p[2]))
                    at += n
                sequence += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 8 else pa.int64()) for k, c in enumerate(cols)], names)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                prompts = list(encode.batch(b.column(3).to_pylist())) if prompt_col else [b""] * b.num_rows
                for doc_id, loss, prompt, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), prompts, encode.batch(b.column(1).to_pylist()), strict=True):
                    ids = prompt + ids + end
                    n = len(ids) // 4
                    finished(packer.add([doc_id, 0, ids, n, min(len(prompt) // 4 + max(loss or 0, 0), n)]))
                    if len(rows) >= 2048:
                        yield flush()
        finished(packer.finish())
        if rows:
            yield flush()

    loss = F.col(loss_start_col).cast("long") if loss_start_col else F.lit(0).cast("long")
    prompt = F.col(prompt_col) if prompt_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), loss.alias("loss"), prompt.alias("prompt")).mapInArrow(run, SCHEMA)
