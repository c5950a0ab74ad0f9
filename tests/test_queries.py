"""Every core query against its SQL on the smallest tables, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from shelfmark.plans import catalog
from tests.helpers import connect, rows_of, sql_rows

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    assert rows_of(df, columns) == sql_rows(con, SQL[name], columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_six_classes(spark, data):
    assert entry.entry(spark).count() == 6
