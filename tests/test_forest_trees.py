import pytest

from facetwatch.operators import ml
from facetwatch.plans import queries


@pytest.mark.parametrize("name", ["isolation_scores", "combined_decision"])
def test_queries_grow_whole_forests(spark, monkeypatch, name):
    seen, real = [], ml.isolation_forest

    def noted(*args, **kw):
        seen.append(kw.get("trees", 100))
        return real(*args, **kw)

    monkeypatch.setattr(ml, "isolation_forest", noted)
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [100] and rows.count() > 0
