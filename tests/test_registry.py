"""Every registered query against its SQL on whole tables."""

import pytest

import __spark_entry__ as entry
from cardwatch.checks import oracle, queries
from tests.check import differences, duck
from tests.conftest import SF001

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_rows_match_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], SQL[name], SF001) is None


def test_entry_has_every_query():
    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.oracle_sql().items() >= SQL.items()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1000
    assert df.columns[:2] == ["user_id", "arrival_seq"]
