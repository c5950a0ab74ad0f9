"""Numbering rows within groups when a group may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.session import stored


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Add each row's place within its group, from 1; no group has to fit into one task.

    The rows are range-partitioned and sorted by group and order, so a large
    group spans several partitions. A row's place is its place among the
    group's rows in its partition plus what the group has in the partitions
    before; that is one small row per group and partition. The rows are stored
    in between, as partition numbers must not change between the two uses.
    """
    keys = [F.col(c) for c in by]
    sorted_rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = stored(
        sorted_rows.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "numbered"
    )
    parts = placed.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__base"))
    w = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1) if by else (
        Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = parts.withColumn("__start", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    on = F.col("a.__p") == F.col("b.__p")
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = placed.alias("a").join(starts.alias("b"), on)
    place = (F.col("b.__start") + F.col("a.__i") - F.col("b.__base") + 1).cast("bigint")
    return joined.select(*(F.col(f"a.{c}") for c in rows.columns), place.alias(name))
