"""Entity-attribute-value tables: scanning, pivoting and changed-only writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalars import is_blank


def in_scope(rows: DataFrame, scope: DataFrame, on: str) -> DataFrame:
    """The rows whose entity is in scope."""
    return rows.join(scope.select(on).distinct(), on, "left_semi")


def last_wins(rows: DataFrame, entity: str, name: str = "name", value: str = "value", order: str = "id") -> DataFrame:
    """One value per entity and attribute: the one with the greatest ``order``.

    The maximum is combined before the exchange, so an entity that holds a
    large part of all rows does not skew it.
    """
    latest = F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    return rows.groupBy(entity, name).agg(latest.alias("x")).select(entity, name, F.col("x.v").alias(value))


def pivoted(rows: DataFrame, entity: str, names: Sequence[str], name: str = "name", value: str = "value", order: str = "id") -> DataFrame:
    """One row per entity with a column for each listed attribute; the last value wins.

    The list is given, so no job has to find the names first.
    """
    latest = [
        F.max(F.when(F.col(name) == n, F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).getField("v").alias(n)
        for n in names
    ]
    return rows.groupBy(entity).agg(*latest)


def attribute_maps(rows: DataFrame, entity: str, name: str = "name", value: str = "value", order: str = "id") -> DataFrame:
    """One map of attributes per entity; the last value of each name wins."""
    one = last_wins(rows, entity, name, value, order)
    return one.groupBy(entity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("attributes"))


def merged_maps(a: Column, b: Column) -> Column:
    """Two maps as one; where both have a key the second one's value counts; null maps are empty."""
    none = F.create_map().cast("map<string, string>")
    first, second = F.coalesce(a, none), F.coalesce(b, none)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def changed_only(desired: DataFrame, stored: DataFrame, entity: str, name: str = "name", value: str = "value") -> DataFrame:
    """The desired attributes that differ from the stored ones: entity, name, value, change.

    Values are compared by digest. Blank desired values are neither written
    nor deleted. ``change`` is insert or replace.
    """
    wanted = desired.where(~is_blank(F.col(value)))
    old = stored.select(entity, name, F.md5(value).alias("__old"), F.lit(True).alias("__there"))
    joined = wanted.join(old, [entity, name], "left")
    differs = ~F.col("__old").eqNullSafe(F.md5(value)) | F.col("__there").isNull()
    change = F.when(F.col("__there").isNull(), "insert").otherwise("replace")
    return joined.where(differs).select(entity, name, value, change.alias("change"))
