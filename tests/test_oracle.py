"""Every query against its SQL on the smallest tables, and no pairing without a key."""

import re

import pytest

import __spark_entry__ as entry
from martflow.catalogue import catalogue
from martflow.oracle import oracles
from tests.compare import database, differences

SQL = oracles()
SPARSE = {"j12_window_join"}  # no window has both kinds of events at this size


@pytest.fixture(scope="module")
def con(small):
    return database(small)


def test_every_query_has_sql():
    assert set(SQL) == set(catalogue())
    assert set(SQL) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, small, name):
    df = entry.queries()[name](spark, small)
    found = differences(df, con, name)
    assert found is None or (found == "no rows" and name in SPARSE)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas", plan)


def test_entry(spark):
    assert entry.entry(spark).columns == ["cur_date", "name", "value"]
