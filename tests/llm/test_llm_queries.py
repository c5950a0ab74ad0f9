"""Queries of the training-data problems: SQL where there is any, and that all of them run."""

import pytest

from shelfmark.llm import queries as q
from tests.helpers import connect, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    df = q.queries()[name](spark, data)
    columns = sorted(df.columns)
    assert rows_of(df, columns) == sql_rows(connect(data), q.oracle_sql()[name], columns)


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    assert q.queries()[name](spark, data).count() >= 0


COLUMNS = {
    "p1_found": ["name_a", "name_b"],
    "p3_found": ["unified_id", "field_name", "best_value"],
    "p4_found": ["tab", "first_id", "member_id"],
    "p5_found": ["topic_id", "unified_id"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_found(spark, data, name):
    assert q.queries()[name](spark, data).columns == COLUMNS[name]
