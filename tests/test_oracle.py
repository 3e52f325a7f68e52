"""Every registered query against its SQL oracle."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, spark_rows, sql_rows

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_rows(spark, folder, con, key):
    names, rows = spark_rows(QUERIES[key](spark, folder))
    expected_names, expected = sql_rows(con, ORACLES[key])
    assert names == expected_names
    assert rows == expected
    assert rows


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
