import pytest
from oracle import DATA, compare

from facetwatch.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name]) >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert QUERIES[name](spark, DATA).count() >= n
