"""The weighted hash tree against a plain walk, its movement laws, slots, and odd rows."""

import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from facetwatch.llm import sharding
from facetwatch.llm.registry import op11_sharding
from oracle import DATA


def plain(key, tree):
    """The same descent in Python; Spark's hash of two strings chains the first one's as the next one's seed."""
    while isinstance(tree, dict):
        total = lambda t: sum(map(total, t.values())) if isinstance(t, dict) else t
        best = None
        for name, below in tree.items():
            seed = 42 if key is None else xxhash.xxh64(key.encode(), seed=42).intdigest()
            u = ((xxhash.xxh64(name.encode(), seed=seed).intdigest() >> 11) + 0.5) / 2**53
            best = max(best or (-math.inf, ""), (math.log(u) / total(below), name))
        tree, name = tree[best[1]], best[1]
    return name


def shards(spark, tree, n=4000):
    return {r.doc_id: r.shard for r in sharding.place(spark.range(n).withColumnRenamed("id", "doc_id"), tree).collect()}


UNEVEN = {"a": {"a1": {"0": 1.0, "1": 3.0}, "a2": {"2": 2.0}}, "b": {"b1": {"3": 1.0, "4": 1.0}, "b2": {"5": 8.0}}}


@pytest.mark.parametrize("tree", [sharding.even_tree(), UNEVEN])
def test_descent_equals_a_plain_walk(spark, tree):
    got = shards(spark, tree, 500)
    assert got == {k: plain(str(k), tree) for k in got}


def test_shares_follow_weights(spark):
    n = Counter(shards(spark, UNEVEN, 20_000).values())
    for shard, w in zip("012345", (1, 3, 2, 1, 1, 8)):
        assert abs(n[shard] / 20_000 - w / 16) < 0.015


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = sharding.even_tree()
    for k in (16, 17):
        more = sharding.grown(tree, k)
        before, after = shards(spark, tree, 8000), shards(spark, more, 8000)
        moved = {d for d in before if before[d] != after[d]}
        assert {after[d] for d in moved} == {str(k)} and abs(len(moved) / 8000 - 1 / (k + 1)) < 0.02
        tree = more


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    before = shards(spark, UNEVEN)
    shifted = shards(spark, {**UNEVEN, "a": {"a1": {"0": 3.0, "1": 1.0}, "a2": {"2": 2.0}}})
    assert {before[d] + shifted[d] for d in before if before[d] != shifted[d]} == {"10"}
    joined = shards(spark, {**UNEVEN, "a": {"a1": {"0": 1.0, "1": 3.0, "6": 2.0}, "a2": {"2": 2.0}}})
    assert {joined[d] for d in before if before[d] != joined[d]} <= set("0126")


def test_trees_that_are_wrong():
    for bad in ({"a": {"0": 0.0}}, {"a": {"0": 1.0}, "1": 1.0}, {"a": {"0": 1.0}, "b": {"0": 1.0}}):
        with pytest.raises(ValueError):
            sharding.path(F.lit("x"), bad)
    with pytest.raises(ValueError):
        sharding.grown(sharding.even_tree(), 3)


def check(docs, rows):
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    rows = rows.collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, "16", 16) and r.law == "key" for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    return rows


def test_digest_of_the_table(spark, docs):
    rows = check(docs, op11_sharding(spark, DATA))
    assert all(r.shard == int(plain(str(r.doc_id), sharding.even_tree())) for r in rows)


def test_odd_rows(spark, odd, empty):
    rows = check(odd, sharding.shard_digest(odd))
    assert {r.shard for r in rows if r.doc_id is None} == {plain(None, sharding.even_tree())}
    assert sharding.shard_digest(empty).collect() == []
    placed = sharding.place(odd, sharding.even_tree())
    assert placed.columns == [*odd.columns, "region", "rack", "shard"] and placed.count() == odd.count()


def test_repeated_rows_get_slots_of_their_own(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    check(df, sharding.shard_digest(df))


def test_plan_is_native_and_without_nested_loops(spark, docs):
    plan = sharding.shard_digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "NestedLoop", "Cartesian"))
    assert "Exchange" not in sharding.place(docs, sharding.even_tree())._jdf.queryExecution().executedPlan().toString()
