"""Every query of the subpackage on the smallest data, against its SQL where it has one."""

import pytest
from oracle import connect, difference

from siltstone.llm import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in ORACLES:
        assert difference(connect(sf), got, ORACLES[name])[1] == ""
    else:
        assert got.toArrow().num_rows > 0


def test_listed(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
