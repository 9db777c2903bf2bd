"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    problem, _, _ = compare(spark, duck, name, QUERIES[name], SQL[name], sf_dir)
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
