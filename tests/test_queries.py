import pytest
from oracle import DATA, compare

import __spark_entry__ as entry
from facetwatch.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["frame", "unit", "votes"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scoring_plan_has_no_sort_merge_of_observations(spark):
    """With statistics at hand the small baseline is broadcast, and the frame window is the one exchange above it."""
    from facetwatch.operators import score

    obs = spark.range(1000).selectExpr("cast(id % 20 as string) frame", "cast(id % 50 as int) unit", "cast(id as double) a")
    base = spark.createDataFrame([(u, "a", 1.0, 1.0) for u in range(50)], "unit int, feature string, median double, mad double")
    plan = score.z_scores(obs, base, "frame", "unit", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
