"""What the plans must and must not hold."""

import re

from facetwatch.llm.decontaminate import leaks
from facetwatch.llm.exact_dedup import exact_dedup
from facetwatch.llm.licenses import license_scan
from facetwatch.llm.line_dedup import line_dedup
from facetwatch.llm.packing import pack


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_have_no_python(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for df in (leaks(docs, items), leaks(docs, items, broadcast_rows=0), line_dedup(docs), line_dedup(docs, broadcast_rows=0), exact_dedup(docs)):
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan(df))


def test_large_benchmarks_are_not_broadcast(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(leaks(docs, items)) and "BroadcastHashJoin" not in plan(leaks(docs, items, broadcast_rows=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_single_pass_operators_do_not_shuffle(docs, vocabulary):
    assert "Exchange" not in plan(pack(docs, vocabulary)) and "Exchange" not in plan(license_scan(docs))


def test_scans_read_the_columns_they_need(spark):
    spark.catalog.clearCache()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert all("lang" not in s and "source" not in s for s in re.findall(r"ReadSchema: (\S+)", plan(exact_dedup(docs))))
