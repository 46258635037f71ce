import io
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetwatch.llm import language, licenses, quality, warc
from facetwatch.llm.common import scratch


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(df).select("doc_id", "lang", language.held_out("doc_id").alias("out"), "lang_pred", "score").collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_language_cases(odd, empty):
    rows = {(r.doc_id, r.text): r for r in language.identify(odd).collect()}
    assert rows[1, None].lang_pred == "und" and rows[8, "12 34 !!"].lang_pred == "und" and rows[2, ""].score == 0
    assert language.identify(empty).count() == 0
    alone = language.predict(odd, language.Model({}))
    assert {r.lang_pred for r in alone.collect()} == {"und"}


def test_mixture_shares():
    rng = np.random.default_rng(1)
    make = lambda syllables, n: " ".join("".join(rng.choice(syllables, 3)) for _ in range(n))
    a, b, c = ["ka", "to", "mi", "re"], ["sch", "ung", "ein", "tz"], ["eau", "oux", "ère", "ique"]
    m = language.Model({k: language.trigrams(make(s, 4000)) for k, s in (("a", a), ("b", b), ("c", c))})
    assert set(m.infer(make(a, 50))) == {"a"}
    mix = m.infer(make(a, 300) + " " + make(b, 100))
    assert set(mix) == {"a", "b"} and abs(mix["a"] - 2100 / 3025) < 0.02 and abs(sum(mix.values()) - 1) < 1e-6


def test_too_many_languages(docs):
    with pytest.raises(ValueError):
        language.train(docs, max_languages=1)


def plain_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    "GNU General Public License and the gnu-general/public.license", "Apache License, apache license; CC BY-SA 4.0 cc by", "mit license" * 2, "MIT\n\nLicense mit licenses", "Ünder the MIT License",
    "", None, "K mit license", "Licensed under the terms of the GNU General Public License, either version 3", "under a CC BY 4.0",
    "Licensed under the Apache License 2", "Licensed under the Apache Licence, Version 2.0", "You may not use this file except in compliance with the License. " + "x " * 12 + "You may obtain a copy of the License at",
    "You may not use this file except in compliance with the License. " + "x " * 13 + "You may obtain a copy of the License at",
]


def test_license_base_counts(spark, docs, odd, empty):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for rows in (df, docs, odd):
        want = sorted(repr((r.doc_id, *plain_scan(r.text))) for r in rows.collect())
        got = licenses.license_scan(rows)
        assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == want
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.collect())
    assert licenses.license_scan(empty).count() == 0


def test_templates():
    scan = licenses.Scanner().scan
    labels = [scan(t)[5] for t in TEXTS]
    assert "gpl-3.0" in labels[8] and "cc-by-4.0" in labels[9] and "apache-2.0" in labels[10]
    assert "apache" not in labels[11], "a wrong mandatory word is not accepted"
    assert "apache-2.0" in labels[12] and "apache-2.0" not in labels[13], "at most twelve words may be replaced"
    own = licenses.Scanner({"x": ["a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d <<var;words=1-2>> e"]}, {})
    assert [own.scan(t)[5] for t in ("a d q e", "a b d q q e", "a b c d q e", "a c d q e", "a d e", "a d q q q e", "z a d q e")] == ["x", "x", "x", "", "", "", "x"]
    with pytest.raises(ValueError):
        licenses.Automaton({"x": ["a <<endOptional>>"]})


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "päge " * 400
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "u\r\nX: y", None), (None, "http://e", big), (-7, "http://f", ""), (9, "http://b", big), (6, "http://g", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1))
    manifest = warc.write_archives(pages, scratch(spark, "warc"), archive_bytes=2000)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    got = warc.read_archives(manifest)
    out = {}
    for r in got.collect():
        out.setdefault(r.page_id, []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    assert [(r.record_type, r.refers_to) for r in out[9]] == [("response", None)] * 2
    for i in (1, 2, None):
        (r,) = out[i]
        assert (r.record_type, r.refers_to, r.payload_bytes, r.payload) == ("revisit", 9, len(big.encode()), None)
        assert r.payload_digest == out[9][0].payload_digest
    assert out[9][0].payload.decode() == big and out[3][0].record_type == out[4][0].record_type == "response"
    assert out[5][0].payload == b"" and out[-7][0].payload_bytes == 0 and len(out[6][0].payload) == 3_000_000
    assert warc.read_archives(warc.write_archives(pages.limit(0), scratch(spark, "warc"))).count() == 0


def test_warc_damage():
    raw = b"".join(warc.make_record(warc.record_id(i), "http://x", bytes([65 + i]) * 5000) for i in range(3))
    assert [warc.page_of(r["record_id"]) for r in warc.read_records(io.BytesIO(raw))] == [0, 1, 2]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(raw[:-5])))
    one = zlib.decompress(warc.make_record(warc.record_id(1), "http://x", b"body " * 300), 31)
    for bad in (one.replace(b"body body", b"bodY body", 1), one[:-2], one + b"x", one.replace(b"Content-Length: ", b"Content-Length: x"), b"no warc\r\n\r\n"):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(z.compress(bad) + z.flush())))


def test_quality_on_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.where("doc_id % 3 > 0")
    got = quality.quality_scores(docs, train).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = [r.quality_score for r in got if r.quality == 1], [r.quality_score for r in got if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    toxic, clean = [r.toxic_score for r in got if r.toxic == 1], [r.toxic_score for r in got if r.toxic == 0]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85


def test_quality_cases(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(odd, none).collect()
    assert len(rows) == odd.count() and {r.quality_score for r in rows} == {0.5}
    some = spark.createDataFrame([(5, 1, 0), (9, 0, 1), (5, 0, None), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(odd, some).count() == odd.count()
    assert quality.quality_scores(empty, some).count() == 0


def test_pseudo_labels_cross_over():
    rng = np.random.default_rng(0)
    y = (np.arange(600) % 2).astype(float)
    words = quality.Rows([np.array([int(v), 2 + rng.integers(20)]) for v in y], 22)
    meta = quality.Dense(np.stack([y + rng.normal(0, 0.3, 600), rng.normal(0, 1, 600)], axis=1))
    labelled, aside = np.arange(600) < 60, np.arange(600) % 5 == 0
    m = quality.co_train(words, meta, np.where(labelled, y, 0), labelled, aside)
    zc, zm = (v.dot(w[:-1]) + w[-1] for v, w in ((words, m.content), (meta, m.meta)))
    a, b, c = m.scores(zc, zm)
    assert ((c > 0.5) == (y > 0.5)).mean() > 0.99 and ((b > 0.5) == (y > 0.5)).mean() > 0.85


def test_numbers_that_are_no_digits_are_no_letters(spark, docs):
    texts = ["\u00bd", "\u00b2\u00b3", "\u2460\u2461", "12 \u00bd \u2166", "", "_ 7", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, "\u00bd of the words here are English words and so is this text")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, language.train(docs)).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(len(texts))) and got[99][0] == "en"


def test_small_languages_are_tried_as_asked(spark, docs):
    model = language.train(docs, least=0.5, rounds=5)
    assert (model.least, model.rounds) == (0.5, 5)
