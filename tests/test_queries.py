"""Every registered query against DuckDB on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_agrees_with_sql(spark, con, name):
    problem, _, _ = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["test", "type", "dataset", "severity", "gate", "status", "violations"]
