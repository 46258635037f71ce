"""Quality classifier by co-training on two views of a page.

Views. The content view sees the different words and symbol runs of the whole
text, by hash place, and its share of capitals and of repeated words. The metadata
view sees source, language, stated length and the layout of lines, and no wording.
Each view has a logistic model.

Sample. The first models are fitted on a bounded sample of labelled rows: those
whose id hash falls below a threshold, set so that about ``sample_rows`` do. Of
the hash places the content view keeps the ``keep`` whose shares differ most
between the classes there (the feature budget). Classes are weighted equally, so
a score of 0.5 is the border whatever their shares are.

Rounds. One pass turns every document into its kept features, which are written.
In each round both views score every document outside the sample. Documents that
a view is sure of are counted over the whole corpus, and ``share`` of the sample
in number, drawn evenly among all of them by id hash, go to the other view as
pseudo-labels. At most ``rounds * share * sample_rows`` rows per view and target
come to the driver in this way, whatever the size of the corpus.

Calibration. At every size the labelled rows are parted into ``FOLDS`` by id hash;
each fold gets logits from models fitted without it. On these logits each view is
calibrated (Platt), and a logistic combination of both calibrated logits is the
score. No document is shuffled.

Defined cases: null text counts as empty and null metadata as a value of its
own; labels that repeat an id are reduced to the worst (null labels are left
out); without labels of both classes every score is the share of positive labels
(0.5 without any); an empty table gives an empty result; rows that repeat an id
are scored each; rows without an id are scored but not in the sample and never
handed over; features that tie are kept in order of their place; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwatch.llm.common import cut

_TOKEN = re.compile(r"\w+|[^\w\s]{1,8}")
#: Hash places of categorical metadata.
_PLACES = 64
N_META = 2 * _PLACES + 12
#: Hash places of words.
BUCKETS = 1 << 18
FOLDS = 3
_RANGE = 1 << 20
_places: dict[str, int] = {}


def content_tokens(text: str | None) -> set[str]:
    """What the content view sees of a text."""
    text = text or ""
    found = _TOKEN.findall(text.lower())
    out = set(found)
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    out.add(f"<capitals {min(9, 20 * upper // max(1, len(text)))}>")
    out.add(f"<repeats {10 * (len(found) - len(out) + 1) // max(1, len(found))}>")
    out.add(f"<symbols {min(9, 20 * sum(not t[0].isalnum() for t in found) // max(1, len(found)))}>")
    return out


def places(text: str | None) -> np.ndarray:
    """The hash places of what the content view sees, each once, in order."""
    if len(_places) > 1_000_000:
        _places.clear()
    put, out = _places.setdefault, set()
    for t in content_tokens(text):
        k = _places.get(t)
        out.add(put(t, zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS) if k is None else k)
    return np.sort(np.fromiter(out, np.int32, len(out)))


def metadata(source: str | None, lang: str | None, n_chars: int | None, text: str | None) -> np.ndarray:
    """What the metadata view sees: categories by hash place, and size and layout."""
    x = np.zeros(N_META)
    x[zlib.crc32(f"source {source}".encode()) % _PLACES] = 1
    x[_PLACES + zlib.crc32(f"lang {lang}".encode()) % _PLACES] = 1
    size = np.log2((n_chars or 0) + 1) / 16 if (n_chars or 0) > -1 else 0
    text = text or ""
    lines = text.count("\n") + 1
    x[2 * _PLACES :] = [1, n_chars is None, size, size**2, np.log2(lines) / 8, np.log2(len(text) / lines + 1) / 8, (len(text) < 100), (len(text) < 400), (len(text) > 5000), source is None, lang is None, text == ""]
    return x


class Rows:
    """Sparse 0/1 rows: feature numbers one after the other, and row ends."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.width, self.n = width, len(rows)
        self.at = np.concatenate([*rows, np.zeros(0, int)]).astype(int)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows]) if rows else np.zeros(0, int)

    @staticmethod
    def of(lists: pa.ChunkedArray, width: int) -> Rows:
        """From a list column, without a Python object for each number."""
        out = Rows([], width)
        n = [np.diff(c.offsets.to_numpy()) for c in lists.chunks]
        out.at = np.concatenate([*(c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks), np.zeros(0, np.int32)])
        out.n = len(lists)
        out.row = np.repeat(np.arange(out.n, dtype=np.int32), np.concatenate(n)) if n else np.zeros(0, int)
        return out

    def only(self, features: np.ndarray) -> Rows:
        """The same rows with some of the features, renumbered."""
        place = np.full(self.width, -1)
        place[features] = np.arange(len(features))
        out, stay = Rows([], len(features)), place[self.at] >= 0
        out.n, out.at, out.row = self.n, place[self.at][stay], self.row[stay]
        return out

    def take(self, rows: np.ndarray) -> Rows:
        """Chosen rows, in the order given."""
        ends = np.searchsorted(self.row, np.arange(self.n + 1))
        return Rows([self.at[ends[r] : ends[r + 1]] for r in rows], self.width)

    def joined(self, more: Rows) -> Rows:
        out = Rows([], self.width)
        out.n, out.at, out.row = self.n + more.n, np.concatenate([self.at, more.at]), np.concatenate([self.row, more.row + self.n])
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=e[self.row], minlength=self.width)


class Dense:
    """Dense rows with the same two products."""

    def __init__(self, rows: np.ndarray):
        self.x, self.n, self.width = rows, *rows.shape

    def take(self, rows: np.ndarray) -> Dense:
        return Dense(self.x[rows])

    def joined(self, more: Dense) -> Dense:
        return Dense(np.concatenate([self.x, more.x]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, e: np.ndarray) -> np.ndarray:
        return self.x.T @ e


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x, y: np.ndarray, use: np.ndarray, w: np.ndarray | None = None, ridge: float = 1.0, steps: int = 80, rate: float = 0.1) -> np.ndarray:
    """Logistic weights (bias last) by Adam on the rows where ``use`` is positive."""
    w = np.zeros(x.width + 1) if w is None else w.copy()
    m, v, total = np.zeros_like(w), np.zeros_like(w), max(1.0, use.sum())
    for t in range(1, steps + 1):
        e = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) * use
        g = np.append(x.back(e) + ridge * w[:-1], e.sum()) / total
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class CoTrained:
    """Both views' weights, their calibrations, and the combination."""

    content: np.ndarray | None
    meta: np.ndarray | None
    calibration: list[np.ndarray]
    combine: np.ndarray | None
    prior: float

    def scores(self, zc: np.ndarray, zm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of each view, and the combined one, from raw logits."""
        if self.content is None:
            same = np.full(len(zc), self.prior)
            return same, same, same
        a, b = (c[0] * z + c[1] for c, z in zip(self.calibration, (zc, zm), strict=True))
        return sigmoid(a), sigmoid(b), sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2])


def telling(x: Rows, y: np.ndarray, known: np.ndarray, keep: int) -> np.ndarray:
    """The features whose shares in the two classes differ by the most standard errors."""
    one, zero = known * y, known * (1 - y)
    n1, n0, t1, t0 = x.back(one), x.back(zero), max(one.sum(), 1.0), max(zero.sum(), 1.0)
    p = (n1 + n0) / (t1 + t0)
    z = np.abs(n1 / t1 - n0 / t0) / np.sqrt(p * (1 - p) * (1 / t1 + 1 / t0) + 1e-9)
    return np.sort(np.argsort(-z, kind="stable")[:keep])


def balanced(y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Row weights under which both classes weigh the same."""
    one, zero = max((use * y).sum(), 1e-9), max((use * (1 - y)).sum(), 1e-9)
    return use * np.where(y == 1, (one + zero) / 2 / one, (one + zero) / 2 / zero)


def logits(x, w: np.ndarray) -> np.ndarray:
    return x.dot(w[:-1]) + w[-1]


class Exchange:
    """Both views of one target: the labelled rows, and what the views were handed.

    ``views`` are the labelled rows as the content view and as the metadata view
    see them, ``y`` their labels, ``fold`` a number of each row's fold.
    """

    def __init__(self, views: list, y: np.ndarray, fold: np.ndarray, share: float, sure: float):
        self.y, self.fold, self.share, self.sure = y, np.unique(fold, return_inverse=True)[1], share, sure
        self.prior = float(y.mean()) if len(y) else 0.5
        self.x, self.target, self.use = list(views), [y, y], [np.ones(len(y)), np.ones(len(y))]
        self.w: list = [None, None]
        #: Both classes must be known, else there is nothing to learn.
        self.open = bool(0 < y.sum() < len(y))

    def _fit(self, k: int, use: np.ndarray, w: np.ndarray | None, steps: int) -> np.ndarray:
        return fit(self.x[k], self.target[k], balanced(self.target[k], use), w, steps=steps)

    def fit(self) -> None:
        self.w = [self._fit(k, self.use[k], self.w[k], 150 if self.w[k] is None else 40) for k in range(2)]

    def sure_of(self, z: list[np.ndarray]) -> np.ndarray:
        """For each row, as bits: which slots (twice the view, plus the class) it is sure enough for.

        Sure under balanced classes: a view that merely knows the larger class has nothing to say.
        """
        p = [sigmoid(a) for a in z]
        return sum((q >= self.sure).astype(np.int32) << (2 * k + c) for k in range(2) for c, q in ((0, 1 - p[k]), (1, p[k])))

    def wanted(self, slot: int) -> float:
        """How many rows a slot hands over in a round."""
        return max(1.0, self.share * len(self.y) * (self.prior if slot % 2 else 1 - self.prior))

    def take(self, slot: int, rows: list) -> None:
        """Hands the rows of a slot to the other view."""
        other, n = 1 - slot // 2, rows[0].n
        self.x[other] = self.x[other].joined(rows[other])
        self.target[other] = np.concatenate([self.target[other], np.full(n, float(slot % 2))])
        self.use[other] = np.concatenate([self.use[other], np.full(n, 0.5)])

    def finish(self) -> CoTrained:
        """The last fit, and calibration on logits from fits without each row's fold."""
        self.fit()
        z = [np.zeros(len(self.y)), np.zeros(len(self.y))]
        for f in range(int(self.fold.max()) + 1):
            out = np.flatnonzero(self.fold == f)
            for k in range(2):
                use = self.use[k].copy()
                use[out] = 0
                z[k][out] = logits(self.x[k], self._fit(k, use, None, 150))[out]
        even = balanced(self.y, np.ones(len(self.y)))
        platt = [fit(Dense(a[:, None]), self.y, even, np.array([1.0, 0.0]), 0.01, 200, 0.05) for a in z]
        both = np.stack([p[0] * a + p[1] for p, a in zip(platt, z, strict=True)], axis=1)
        combine = fit(Dense(both), self.y, even, np.array([1.0, 0.2, 0.0]), 0.01, 200, 0.05)
        return CoTrained(self.w[0], self.w[1], platt, combine, self.prior)


def drawn(draw: np.ndarray, wanted: float, found: int) -> np.ndarray:
    """An even choice of about ``wanted`` of the ``found`` rows of a slot, by their draws from 0 to 1."""
    return draw * found < wanted


def co_train(content: Rows, meta: Dense, y: np.ndarray, labelled: np.ndarray, fold: np.ndarray, draw: np.ndarray | None = None, rounds: int = 3, share: float = 0.15, sure: float = 0.97, keep: int = 1000) -> CoTrained:
    """All rounds over rows in memory; ``y`` counts where ``labelled``. The Spark form is held against this one."""
    known, draw = np.flatnonzero(labelled), np.arange(len(y)) / len(y) if draw is None else draw
    best = telling(content.take(known), y[known], np.ones(len(known)), keep)
    views = [content.only(best), meta]
    model = Exchange([v.take(known) for v in views], y[known], fold[known], share, sure)
    if not model.open:
        return CoTrained(None, None, [], None, model.prior)
    free = ~labelled
    for _ in range(rounds):
        model.fit()
        slots = model.sure_of([logits(v, w) for v, w in zip(views, model.w, strict=True)])
        gone = np.zeros(len(y), bool)
        for slot in range(4):
            mine = free & (slots >> slot & 1 == 1)
            rows = np.flatnonzero(mine & drawn(draw, model.wanted(slot), mine.sum()))
            model.take(slot, [v.take(rows) for v in views])
            gone[rows] = True
        free &= ~gone
    out = model.finish()
    whole = np.zeros(content.width + 1)
    whole[best], whole[-1] = out.content[:-1], out.content[-1]
    out.content = whole
    return out


def quality_scores(
    docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", sample_rows: int = 12_000, keep: int = 1000, rounds: int = 3, share: float = 0.15, sure: float = 0.97,
) -> DataFrame:
    """``doc_id`` and, per target, ``<target>_content, <target>_meta, <target>_score``."""
    spark = docs.sparkSession
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"), F.col(size_col).cast("long").alias("n_chars"),
    )
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(t).cast("double").alias(t) for t in targets)).where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(*((F.max if t == "toxic" else F.min)(t).alias(t) for t in targets))
    n = marks.count()
    top = _RANGE if n <= sample_rows else max(1, int(_RANGE * sample_rows / n))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(_RANGE)) < top)

    def features(place: np.ndarray | None):
        """Maps documents to ``at`` (all places, or those kept, renumbered) and ``meta``; further columns pass."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = None if place is None else kept.value
            for b in batches:
                text, source, lang, size = (b.column(k).to_pylist() for k in range(4))
                at = [places(x) for x in text]
                if get is not None:
                    at = [k[k >= 0] for k in (get[a] for a in at)]
                ends = pa.array(np.cumsum([0, *map(len, at)]).astype(np.int32))
                meta = np.array([metadata(*m) for m in zip(source, lang, size, text, strict=True)], np.float64).reshape(-1, N_META)
                cols = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*at, np.zeros(0, np.int32)]).astype(np.int32))), pa.ListArray.from_arrays(pa.array(np.arange(0, N_META * (b.num_rows + 1), N_META, dtype=np.int32)), pa.array(meta.ravel()))]
                yield pa.RecordBatch.from_arrays([*cols, *b.columns[4:]], ["at", "meta", *b.schema.names[4:]])

        return run

    def views_of(table: pa.Table, width: int) -> list:
        return [Rows.of(table.column("at"), width), Dense(np.concatenate([*(c.flatten().to_numpy() for c in table.column("meta").chunks), np.zeros(0)]).reshape(-1, N_META))]

    fields, four = "at array<int>, meta array<double>", ["text", "source", "lang", "n_chars"]
    # About sample_rows labelled rows, however many labels there are.
    sample = rows.join(F.broadcast(chosen), "doc_id").select(*four, "doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), *targets)
    got = sample.mapInArrow(features(None), fields + ", doc_id long, fold int" + "".join(f", {t} double" for t in targets)).toArrow()
    got = got.sort_by("doc_id")
    content, meta = views_of(got, BUCKETS)
    mine, fold = got.column("doc_id").to_numpy(), got.column("fold").to_numpy()
    exchange, best = {}, {}
    for t in targets:
        y = got.column(t).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(~np.isnan(y))
        best[t] = telling(content.take(known), y[known], np.ones(len(known)), keep)
        exchange[t] = Exchange([content.only(best[t]).take(known), meta.take(known)], y[known], fold[known], share, sure)
    union = np.unique(np.concatenate([*best.values(), np.zeros(0, int)])).astype(int)
    place = np.full(BUCKETS, -1, np.int32)
    place[union] = np.arange(len(union))
    own = {t: np.searchsorted(union, b) for t, b in best.items()}  # each target's features among all that are kept
    kept = spark.sparkContext.broadcast(place)
    stored = cut(rows.select(*four, "doc_id", draw.alias("draw")).mapInArrow(features(place), fields + ", doc_id long, draw double"))
    open_ = [t for t in targets if exchange[t].open]
    # Rows of the sample and rows handed over before: a bounded number.
    gone = {t: set(mine.tolist()) for t in open_}
    for _ in range(rounds if open_ else 0):
        for t in open_:
            exchange[t].fit()
        state = spark.sparkContext.broadcast(({t: exchange[t].w for t in open_}, gone))

        def sure_rows(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            weights, gone = state.value
            for b in batches:
                table = pa.Table.from_batches([b])
                x, dense = views_of(table, len(union))
                ids = b.column(2).to_pylist()
                for k, t in enumerate(open_):
                    slots = exchange_of(t).sure_of([logits(v, w) for v, w in zip((x.only(own[t]), dense), weights[t], strict=True)])
                    free = np.array([i is not None and i not in gone[t] for i in ids], bool)
                    for slot in range(4):
                        rows = np.flatnonzero(free & (slots >> slot & 1 == 1))
                        if len(rows):
                            part = table.take(pa.array(rows))
                            part = part.append_column("slot", pa.array(np.full(len(rows), 4 * k + slot, np.int32)))
                            yield from part.combine_chunks().to_batches()

        rules = {t: Exchange([], np.zeros(0), np.zeros(0, int), share, sure) for t in open_}
        exchange_of = rules.__getitem__
        found = stored.mapInArrow(sure_rows, fields + ", doc_id long, draw double, slot int")
        counts = {r["slot"]: r["n"] for r in found.groupBy("slot").agg(F.count("*").alias("n")).collect()}  # at most four slots a target
        if not counts:
            break
        most = F.lit(0.0)
        for s, n in counts.items():
            most = F.when(F.col("slot") == s, F.lit(exchange[open_[s // 4]].wanted(s % 4) / n)).otherwise(most)
        handed = found.where(F.col("draw") < most).toArrow().sort_by([("slot", "ascending"), ("doc_id", "ascending")])
        x, dense = views_of(handed, len(union))
        slot, ids = handed.column("slot").to_numpy(), handed.column("doc_id").to_numpy()
        for s in np.unique(slot).tolist():
            t, at = open_[s // 4], np.flatnonzero(slot == s)
            exchange[t].take(s % 4, [x.only(own[t]).take(at), dense.take(at)])
            gone[t] |= set(ids[at].tolist())
    models = {t: exchange[t].finish() if exchange[t].open else CoTrained(None, None, [], None, exchange[t].prior) for t in targets}
    shared = spark.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, dense = views_of(pa.Table.from_batches([b]), len(union))
            cols = [b.column(2)]
            for t, m in shared.value.items():
                z = [np.zeros(b.num_rows)] * 2 if m.content is None else [logits(v, w) for v, w in ((x.only(own[t]), m.content), (dense, m.meta))]
                cols += [pa.array(s) for s in m.scores(*z)]
            yield pa.RecordBatch.from_arrays(cols, out)

    out = ["doc_id", *(f"{t}_{k}" for t in targets for k in ("content", "meta", "score"))]
    return stored.mapInArrow(score, "doc_id long" + "".join(f", {c} double" for c in out[1:]))
