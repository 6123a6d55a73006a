"""Registered queries: equality with their SQL twins, and plans without pairings of everything with everything."""

import pytest
from compare import difference, oracle
from conftest import SMALL

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


@pytest.mark.parametrize("key", sorted(SQL))
def test_twin(spark, con, key):
    df = QUERIES[key](spark, SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical, plan
    assert difference(df, con, SQL[key]) is None


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_narrow_queries_read_narrow(spark):
    plan = QUERIES["brand_value_counts"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "p_retailprice" not in plan
