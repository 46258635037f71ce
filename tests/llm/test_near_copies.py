import random
from itertools import combinations

import corpus_pipeline


def brute(rows, least=0.8):
    """Ids that stay, by all pairs of 5-word shingle sets."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both and both >= least * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i for i in sets if find(i) == i}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_catches_jaccard(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for _ in range(30):
        base = [word() for _ in range(rng.randint(40, 400))]
        rows.append(" ".join(base))
        for edits in (1, 2, 4, 6, 8):
            copy = list(base)
            for k in rng.sample(range(len(copy)), max(1, edits * len(copy) // 400)):
                copy[k] = word()
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, table(spark, rows), "").collect()}
    assert kept == brute(rows)


def test_chains_within_a_band(spark):
    """Neighbours are 0.8 alike and the ends are not, with more members than the first centres of a band."""
    words = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(words)))
        words[(7 * k) % 100] = f"new{k}"
        words[(7 * k + 1) % 100] = f"more{k}"
    random.Random(1).shuffle(rows)
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, table(spark, rows), "").collect()}
    assert kept == brute(rows)


def test_stage_on_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == brute([(r.doc_id, r.text) for r in docs.collect()])
