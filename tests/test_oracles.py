"""Every query of the core on the smallest data, against its SQL; those without SQL must run."""

import pytest
from oracle import connect, difference

from siltstone.plans import registry

#: Queries whose operator Spark has no expression for.
PYTHON = {"geowave_within_box", "geowave_intersects", "json_flatten_normal", "json_flatten_grouped", "json_flatten_both", "visibility_filter", "masked_values"}
PYTHON |= {"geowave_contains", "geowave_covers", "geowave_covered_by", "geowave_overlaps", "geowave_crosses", "lucene_geowave", "lucene_geowave_within"}
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan or name in PYTHON
    if name in ORACLES:
        assert difference(con, got, ORACLES[name])[1] == ""
    else:
        got.toArrow()


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
