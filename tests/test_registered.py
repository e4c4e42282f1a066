"""Every registered query: its plan, and its rows against its SQL on the same tables."""

import pytest

import __spark_entry__ as entry
from meshledger import catalog
from oracle import compare, connect

# Joins that pair every row with every row, and Python run row by row.
NEVER = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in NEVER if node in plan]
    assert "MapInPandas" not in plan or name.startswith("call_trace")
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        # The smallest tables leave a few results empty; the larger ones fill them.
        assert compare(spark, con, lambda *_: df, sql, sf_dir) in (None, "no rows")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
