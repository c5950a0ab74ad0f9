"""The catalogue of core queries: name to function, and name to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans import derived, matching, nested, writing

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (matching, derived, nested, writing)


def queries() -> dict[str, Query]:
    """All core queries; each takes a session and the folder of the tables."""
    return {name: f for m in _MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    """SQL that gives the same rows, for the queries that SQL can express."""
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
