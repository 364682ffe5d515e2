"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

PLANS, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, sf, name):
    rows, _, problem = compare(spark, con, PLANS[name], SQL[name], sf)
    spark.catalog.clearCache()
    assert problem is None
    assert rows >= 0


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_other_queries_give_rows(spark, sf, name):
    assert PLANS[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(PLANS)
