import corpus_pipeline
from test_decontaminate import brute
from test_dedup import brute_lines
from test_near_copies import brute as brute_alike
from test_tokens import check_packing

from facetwatch.llm import packing, registry
from facetwatch.llm.common import scratch


def stored(spark, df):
    path = scratch(spark, "stage")
    df.write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_stages_follow_brute_force(spark, docs, vocabulary):
    d, columns = "/root/testdata/sf0.001", docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["languages", "lines", "near_copies", "benchmark", "packing"]
    a = stored(spark, stages["languages"](spark, docs, d))
    have = {r.doc_id for r in a.collect()}
    assert {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)} >= have and len(have) > 0.95 * docs.count()

    b = stored(spark, stages["lines"](spark, a, d))
    rows = a.collect()
    want = [(r.doc_id, t, r.lang, r.source, len(t) if gone else r.n_chars) for r, (_, t, _, gone) in zip(rows, brute_lines([(r.doc_id, r.text, r.source) for r in rows])) if not gone or t.strip(" ")]
    assert rows_of(b) == sorted(map(repr, want))

    c = stored(spark, stages["near_copies"](spark, b, d))
    assert {r.doc_id for r in c.collect()} == brute_alike([(r.doc_id, r.text) for r in b.collect()])

    e = stored(spark, stages["benchmark"](spark, c, d))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    leaked = {x[0] for x in brute([(r.doc_id, r.text) for r in c.collect()], items)}
    assert {r.doc_id for r in e.collect()} == {r.doc_id for r in c.collect()} - leaked
    assert all(x.columns == columns for x in (a, b, c, e))

    last = packing.pack(e, vocabulary)
    assert check_packing(last.collect(), [(r.doc_id, r.text) for r in e.collect()], vocabulary) == 0
    cols = ["doc_id", "start", "length", "doc_tokens"]
    assert rows_of(stages["packing"](spark, e, d).select(cols)) == rows_of(last.select(cols)) == rows_of(corpus_pipeline.run(spark, d).select(cols))


def test_odd_documents_pass_all_stages(spark, odd, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for df in (odd.select(columns), empty):
        for name, stage in corpus_pipeline.STAGES:
            df = stored(spark, stage(spark, df, "/root/testdata/sf0.001"))
        assert df.columns[:3] == ["doc_id", "start", "length"]


def test_every_number_has_one_query():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in registry.QUERIES) == 1
