"""Language ID by multilingual mixture inference.

Training. Character trigrams of all labelled documents are counted per language
in one pass (per task, then by one aggregation), over a fixed number of hash
buckets; the smoothed counts are one distribution per language. The model's
size is buckets times languages, whatever the corpus, and the number of
languages is checked against ``max_languages`` before it goes to the tasks.

Inference. A document is a mixture of languages. Expectation-maximisation
estimates the proportions from the trigram likelihoods. The language set is
chosen by penalised likelihood: it starts with the best single language and
takes in the language that raises the likelihood most, as long as the gain in
log likelihood is above the penalty ``penalty * log(trigrams)`` for one more
proportion. If even the mixture of all languages gains less than that, the
single language stands. Languages whose proportion in the mixture of all is ``least``
or less are not tried, and estimation ends after ``rounds`` rounds. The prediction is the
language with the largest proportion, and the score is that proportion.

Defined cases: null text and text without a letter (digits, fractions, raised and
circled numbers are none) give ``und`` with score 0, as does a model without languages; ties go to the language that sorts first;
texts of any length are read whole, in blocks; rows that repeat an id are
judged each; a null id is never held out; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetwatch.llm.common import claim

BUCKETS = 1 << 15
#: Letters, and numbers that are not decimal digits.
_LETTER = re.compile(r"[^\W\d_]")
#: Characters that are counted at a time.
_BLOCK = 1 << 20
#: What is not a letter below U+0250 counts as a space.
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(0x250)], np.uint32)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def trigrams(text: str) -> np.ndarray:
    """Bucket counts of the trigrams of a text in lower case."""
    text, out = f" {text.lower()} ", np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(text) - 2), _BLOCK):
        c = np.frombuffer(text[at : at + _BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(c < 0x250, _FOLD[np.minimum(c, 0x24F)], c)
        keep = (c[1:-1] != 32) | (c[2:] != 32)
        h = (c[:-2] * np.uint32(2654435761) ^ c[1:-1] * np.uint32(2246822519) ^ c[2:] * np.uint32(3266489917))[keep]
        out += np.bincount((h ^ h >> np.uint32(15)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


class Model:
    """Trigram distributions of the languages, in sorted order."""

    def __init__(self, counts: dict[str, np.ndarray], smoothing: float = 0.5, penalty: float = 3.0, least: float = 0.01, rounds: int = 30):
        self.languages = sorted(counts)
        self.penalty, self.least, self.rounds = penalty, least, rounds
        n = np.array([counts[x] for x in self.languages], float).reshape(len(self.languages), BUCKETS).T + smoothing
        self.p = n / n.sum(axis=0)

    @staticmethod
    def mixture(n: np.ndarray, p: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation, and their log likelihood."""
        share = np.full(p.shape[1], 1 / p.shape[1])
        total = n.sum()
        for _ in range(rounds):
            mixed = p @ share
            new = share * ((n / mixed) @ p) / total
            moved, share = np.abs(new - share).max(), new
            if moved < 1e-3:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> dict[str, float]:
        """Proportions of the languages in the chosen set; empty for ``und``."""
        if not self.languages or not text or not has_letter(text):
            return {}
        counts = trigrams(text)
        at = np.flatnonzero(counts)
        n, p = counts[at].astype(float), self.p[at]
        single = n @ np.log(p)
        chosen, best = [int(np.argmax(single))], float(single.max())
        share = np.ones(1)
        if len(self.languages) > 1:
            cost = self.penalty * np.log(n.sum() + 1)
            whole, top = self.mixture(n, p, self.rounds)
            while top - best > cost:
                rest = [k for k in np.flatnonzero(whole > self.least).tolist() if k not in chosen]
                tried = [(self.mixture(n, p[:, [*chosen, k]], self.rounds), k) for k in rest]
                if not tried:
                    break
                (new, value), k = max(tried, key=lambda x: x[0][1])
                if value - best <= cost:
                    break
                chosen, share, best = [*chosen, k], new, value
        return {self.languages[k]: float(x) for k, x in zip(chosen, share, strict=True)}


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = 256, **options) -> Model:
    """Counts trigrams per language over all given rows with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])
            held.clear()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                n = trigrams(text.as_py())
                held[lang] = held[lang] + n if lang in held else n
                if len(held) > 64:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    found = per.limit(max_languages + 1).collect()  # each row is at most BUCKETS numbers
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    table = {}
    for r in found:
        table[r["lang"]] = np.zeros(BUCKETS)
        table[r["lang"]][np.array(r["bucket"], int)] = r["n"]
    return Model(table, **options)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, mixture`` added (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator) -> Iterator:
        for texts in batches:
            rows = []
            for text in texts:
                mix = shared.value.infer(text.as_py())
                best = min(mix, key=lambda k: (-mix[k], k), default="und")
                rows.append({"lang": best, "score": min(1.0, mix.get(best, 0.0)), "mixture": list(mix.items())})
            yield pa.array(rows, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))]))

    from pyspark.sql.functions import arrow_udf

    # Annotated this way because annotations here are strings.
    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = arrow_udf(judge, "lang string, score double, mixture map<string,double>")(F.col(text_col))
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "mixture", "__mix")]
    return docs.withColumn("__mix", found).select(*rest, F.col("__mix.lang").alias("lang_pred"), F.col("__mix.score").alias("score"), F.col("__mix.mixture").alias("mixture"))


def held_out(id_col: str) -> Column:
    """True for the quarter of ids that training leaves out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on the rows that are not held out and judges all rows."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    return predict(docs, model, text_col)
