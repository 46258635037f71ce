"""Language ID and the quality classifier against plain code on few rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetwatch.llm import language, quality


def plain_counts(text):
    s = [c for c in f" {text.lower()} "]
    s = [ord(c) if ord(c) >= 0x250 or c.isalpha() else 32 for c in s]
    out = {}
    for a, b, c in zip(s, s[1:], s[2:]):
        if b == 32 and c == 32:
            continue
        h = (a * 2654435761 ^ b * 2246822519 ^ c * 3266489917) & 0xFFFFFFFF
        k = (h ^ h >> 15) & (language.BUCKETS - 1)
        out[k] = out.get(k, 0) + 1
    return out


def plain_mixture(counts, p):
    share = [1 / len(p)] * len(p)
    for _ in range(30):
        new = [0.0] * len(p)
        for k, n in counts.items():
            mixed = sum(w * q[k] for w, q in zip(share, p))
            for j, q in enumerate(p):
                new[j] += n * share[j] * q[k] / mixed
        new = [x / sum(counts.values()) for x in new]
        moved, share = max(abs(a - b) for a, b in zip(new, share)), new
        if moved < 1e-3:
            break
    return share, sum(n * math.log(sum(w * q[k] for w, q in zip(share, p))) for k, n in counts.items())


def plain_language(text, model, names):
    """Best set of languages by penalised likelihood, and their shares."""
    if not text or not any(c.isalpha() for c in text):
        return {}
    n = plain_counts(text)
    cost = 3.0 * math.log(sum(n.values()) + 1)
    single = [sum(c * math.log(model[x][k]) for k, c in n.items()) for x in names]
    chosen, best, share = [max(range(len(names)), key=lambda j: (single[j], -j))], max(single), [1.0]
    whole, top = plain_mixture(n, [model[x] for x in names])
    while top - best > cost:
        tried = [(plain_mixture(n, [model[names[j]] for j in [*chosen, k]]), k) for k in range(len(names)) if whole[k] > 0.01 and k not in chosen]
        if not tried:
            break
        (new, value), k = max(tried, key=lambda x: x[0][1])
        if value - best <= cost:
            break
        chosen, share, best = [*chosen, k], new, value
    return {names[j]: w for j, w in zip(chosen, share)}


def test_language_equals_plain_code(spark, docs):
    few = docs.where("char_length(text) between 40 and 1500 and lang is not null").orderBy("doc_id").limit(12)
    extra = [(900, None, "en"), (901, "", "en"), (902, "12 !!", "fr"), (903, "ünïcödé 中文 Σς mehr Wörter hier", None)]
    both = few.collect()
    mixed = " ".join(r.text for r in both if r.lang == both[0].lang) + " " + " ".join(r.text for r in both if r.lang != both[0].lang)
    df = few.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([*extra, (904, mixed, None)], "doc_id long, text string, lang string"))
    rows = df.collect()
    counts = {}
    for r in rows:
        if r.text is not None and r.lang is not None and not (r.doc_id is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2):
            for k, n in plain_counts(r.text).items():
                counts.setdefault(r.lang, [0.5] * language.BUCKETS)[k] += n
    names = sorted(counts)
    model = {x: [v / sum(counts[x]) for v in counts[x]] for x in names}
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(names) > 1 and len(got) == len(rows)
    for r in rows:
        want = plain_language(r.text, model, names)
        best = min(want, key=lambda x: (-want[x], x), default="und")
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(min(1.0, want.get(best, 0.0)), abs=1e-6)
        assert dict(got[r.doc_id].mixture) == pytest.approx(want, abs=1e-6)


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality_equals_the_rounds_in_memory(spark, labelled):
    docs, labels = labelled
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(quality.FOLDS)).cast("int")
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.join(marks, "doc_id", "left").select("*", draw.alias("draw"), fold.alias("fold")).orderBy("doc_id").collect()
    content = quality.Rows([quality.places(r.text) for r in rows], quality.BUCKETS)
    meta = quality.Dense(np.array([quality.metadata(r.source, r.lang, r.n_chars, r.text) for r in rows]))
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    for t in ("quality", "toxic"):
        y = np.array([np.nan if r[t] is None else float(r[t]) for r in rows])
        known = ~np.isnan(y)
        m = quality.co_train(content, meta, np.nan_to_num(y), known, np.array([r.fold for r in rows]), np.array([r.draw for r in rows]))
        want = m.scores(*(quality.logits(x, w) for x, w in ((content, m.content), (meta, m.meta))))
        for name, values in zip(("content", "meta", "score"), want):
            assert np.allclose([got[r.doc_id][f"{t}_{name}"] for r in rows], values, atol=1e-5)


def test_fit_finds_the_weights(spark):
    """Adam's logistic weights against Newton's, on dense rows."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 3))
    y = (rng.random(300) < quality.sigmoid(x @ [1.0, -2.0, 0.5] + 0.3)).astype(float)
    w, design = np.zeros(4), np.c_[x, np.ones(300)]
    for _ in range(30):
        p = quality.sigmoid(design @ w)
        g = design.T @ (p - y) + np.array([1, 1, 1, 0]) * w
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1.0, 1, 1, 0]), g)
    assert np.allclose(quality.fit(quality.Dense(x), y, np.ones(300), steps=2000, rate=0.05), w, atol=1e-3)


def test_quality_rules(spark):
    """Pseudo-labels reach every document, ties share a score, null and repeated labels count as stated."""
    rows = [(i, f"good plain words number {i % 7}" if i % 2 else f"BAD!!! $$$ ### {i % 7}", "s", "en", 10) for i in range(400)] + [(1000, "good plain words number 1", "s", "en", 10), (1000, "good plain words number 1", "s", "en", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert all((r.quality_score > 0.5) == (r.doc_id % 2 == 1 or r.doc_id == 1000) for r in got) and {r.toxic_score for r in got} == {0.5}
    same = {r.quality_score for r in got if r.doc_id in (1, 15, 1000)}
    assert len(same) == 1 and sum(r.doc_id == 1000 for r in got) == 2
    # One row of a class is enough to go on, at any size.
    one = quality.quality_scores(docs, labels.where("doc_id in (0, 1)")).collect()
    assert len(one) == len(got) and all(0 <= r.quality_score <= 1 for r in one)
