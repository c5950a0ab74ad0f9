"""Queries that shred nested catalogue records into flat tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators.shred import children, flat_table
from shelfmark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return children(table(spark, d, "raw_records"))


def _flat(child: str) -> Query:
    return lambda spark, d: flat_table(table(spark, d, "raw_records"), child)


def queries() -> dict[str, Query]:
    return {
        "p2_found": p2_found,
        "p2_sources": _flat("sources"),
        "p2_identifiers": _flat("issn_details"),
        "p2_topics": _flat("topics"),
        "p2_years": _flat("counts_by_year"),
    }


def oracle_sql() -> dict[str, str]:
    # The shapes vary by row and strings hold JSON again; checked against brute force in the tests.
    return {}
