"""Every query with SQL agrees with DuckDB to the last digit."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    found = difference(QUERIES[name](spark, sf_dir), con, SQL[name])
    assert found is None, found


def test_entry(spark):
    row = entry.entry(spark).first()
    assert 0 <= row["overall_score"] <= 100
