import random
import re

from facetwatch.llm.decontaminate import decontaminate, leaks


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, k=5, share=0.8):
    out = set()
    for item, text in items:
        w = words(text)
        if not w:
            continue
        n = min(k, len(w))
        own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for doc, t in docs:
            d = words(t)
            found = {tuple(d[i : i + n]) for i in range(len(d) - n + 1)}
            c = len(own & found)
            if c >= share * len(own) - 1e-9:
                out.add((doc, item, len(own), c))
    return out


def check(spark, docs, items, **options):
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in leaks(docs, items, **options).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    return got


def test_planted_passages(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 8, 20, 60])))) for i in range(30)] + [(90, None), (91, ""), (92, "?!"), (93, "aa aa aa aa aa aa aa aa")]
    docs = []
    for i in range(80):
        body = rng.choices(vocab, k=rng.randint(0, 300))
        w = items[rng.randrange(30)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = "changed"
        at = rng.randint(0, len(body))
        docs.append((i, (" " if i % 2 else ", ").join(body[:at] + [x.upper() if i % 3 == 0 else x for x in w] + body[at:])))
    docs += [(200, None), (201, ""), (202, "aa " * 50), (None, items[4][1]), (1, "second row of an id")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = check(spark, docs, items)
    assert len(got) > 10
    check(spark, docs, items, broadcast_rows=0)


def test_table_and_stage(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = check(spark, docs, items)
    kept = {r.doc_id for r in decontaminate(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, *_ in got}


def test_empty(spark, empty, odd):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert leaks(empty, items).count() == 0 and leaks(odd, items.limit(0)).count() == 0
    assert decontaminate(odd, items.limit(0)).count() == odd.count()
