"""Every registered query with SQL equals that SQL on the smallest data set."""

import duckdb  # noqa: F401
import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    status, note = compare(spark, con, name, SF, QUERIES, ORACLE)
    assert status == "ok", note


def test_names():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
