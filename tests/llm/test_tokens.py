import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetwatch.llm import packing, tokens


def test_counts_match_the_library(docs, odd, empty, vocabulary):
    t = tokens.model(vocabulary)
    for df, pairs in ((docs, tokens.BLOCK_PAIRS), (odd, tokens.BLOCK_PAIRS), (odd, 3)):
        want = sorted(repr((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 2048)) for r in df.collect())
        assert sorted(repr(tuple(r)) for r in tokens.token_counts(df, vocabulary, block_pairs=pairs).collect()) == want
    assert tokens.token_counts(empty, vocabulary).count() == 0


def test_sentencepiece_counts(odd, vocabulary):
    path = vocabulary.replace("word_bpe_49k.json", "piece_bpe_32k.model")
    t = tokens.model(path)
    for r in tokens.token_counts(odd, path).collect():
        if r.doc_id == 10:
            assert r.n_tokens == len(t.encode("ünïcödé 中文 😀 Σς"))


ALPHABET = "abzABZ '’srtveldm09²½,.!?<|>\t\n\r\x0b\x0c\x1c\x85\xa0ÀéÏßÿİıŉſµªºΣσς́H̱中漢ñ😀　—"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=ALPHABET, max_size=30), st.text(max_size=20), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "don't", "It'S", " ", "x"])).map("".join)))
def test_parts_are_independent(text):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    t = tokens.model(path)
    whole = t.encode(text, add_special_tokens=False).ids
    for split in (tokens.pre_tokens, tokens.stretches):
        assert [i for p in split(text) for i in t.encode(p, add_special_tokens=False).ids] == whole
    assert np.frombuffer(next(packing.Encoder(path).batch([text])), "<u4").tolist() == whole


def check_packing(rows, texts, vocabulary, limit=4096, segments=1024):
    """Every id in exactly one piece, sequences gapless and within limits; returns the padding."""
    t = tokens.model(vocabulary)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    want = defaultdict(int)
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids)] += 1
    for key, n in want.items():
        assert sum(r.length for r in pieces[key]) == n * key[1]
    assert set(pieces) == set(want)
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        if want[i, len(ids)] > 1:
            continue
        got = sorted(pieces[i, len(ids)], key=lambda r: r.start)
        assert [r.start for r in got] == [0, *np.cumsum([r.length for r in got])[:-1]]
        for r in got:
            assert r.ids == ids[r.start : r.start + r.length].tobytes() and zlib.crc32(r.ids) >= 0
    padding = 0
    for s in sequences.values():
        s = sorted(s, key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]]
        n = sum(r.length for r in s)
        assert n <= limit and len(s) <= segments and all(r.sequence_tokens == n for r in s)
        padding += 0 if n & (n - 1) == 0 else limit - n
    return padding


def test_packing(docs, odd, empty, vocabulary):
    for df in (docs, odd):
        rows = packing.pack(df, vocabulary).collect()
        assert check_packing(rows, [(r.doc_id, r.text) for r in df.collect()], vocabulary) == 0
    assert packing.pack(empty, vocabulary).count() == 0


def test_limits_on_segments_and_loss(spark, vocabulary):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(0, 900), rng.randint(0, 500) if i % 3 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt int")
    out = packing.pack(df, vocabulary, loss_start_col="prompt", max_tokens=1024, max_segments=3, max_loss=600, window=16).collect()
    check_packing(out, [(r[0], r[1]) for r in rows], vocabulary, 1024, 3)
    loss, want = defaultdict(int), {i: max(0, len(t.split()) + 1 - min(p or 0, len(t.split()) + 1)) for i, t, p in rows}
    total = defaultdict(int)
    for r in out:
        loss[r.sequence_id] += r.loss_tokens
        total[r.doc_id] += r.loss_tokens
    assert max(loss.values()) <= 600 and dict(total) == {i: n for i, n in want.items()}


def test_prompts_bear_no_loss(spark, vocabulary):
    rows = [(i, "answer " * (i + 1), None if i % 5 == 0 else "question " * i) for i in range(40)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, ask string"), vocabulary, prompt_col="ask", max_tokens=64, max_loss=40, window=8).collect()
    check_packing(out, [(i, f"{a or ''}{t}") for i, t, a in rows], vocabulary, 64)
    total = defaultdict(int)
    for r in out:
        total[r.doc_id] += r.loss_tokens
    assert dict(total) == {i: i + 2 for i in range(40)}


def test_bad_limits(docs, vocabulary):
    with pytest.raises(ValueError):
        packing.pack(docs, vocabulary, max_tokens=0)
