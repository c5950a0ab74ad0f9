"""From classified groups to actions, and paging through groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.operators.match import Matched
from shelfmark.operators.ranking import numbered
from shelfmark.session import stored


def action_plan(matched: Matched, create_all: bool = False) -> DataFrame:
    """One row per action: action (update, create, delete), right_id, left_id.

    Both sides of a group are paired by position: a pair updates, a left row
    alone is deleted, a right row alone is created. Of a group with right rows
    only just the first is created unless ``create_all``. A right id that is
    planned twice keeps the update with the greatest left id.

    Groups with one row on either side pair their first rows, without being
    numbered. Match with ``keep``, as the rows are used several times.
    """
    none = F.lit(None).cast("bigint")
    groups = matched.groups
    rows = matched.rows.join(groups.select("group", "n", "m", "left_first", "right_first"), "group")
    place = F.struct("ord", "id")
    is_left, two_sided, numbered_one = F.col("side") == "l", (F.col("n") > 0) & (F.col("m") > 0), (F.col("n") > 1) & (F.col("m") > 1)
    many = numbered(rows.where(numbered_one).select("group", "side", "ord", "id"), ["group", "side"], [F.col("ord"), F.col("id")])
    met = many.groupBy("group", "pos").agg(
        F.max(F.when(is_left, F.col("id"))).alias("left_id"), F.max(F.when(~is_left, F.col("id"))).alias("right_id")
    ).select("left_id", "right_id")
    firsts = groups.where(two_sided & ~numbered_one).select(F.col("left_first.id").alias("left_id"), F.col("right_first.id").alias("right_id"))
    first = F.when(is_left, F.col("left_first")).otherwise(F.col("right_first"))
    # Of two-sided groups what comes after the first, of one-sided ones everything that counts.
    counts = F.when(two_sided, ~numbered_one & (place != first)).otherwise(is_left | F.lit(create_all) | (place == first))
    alone = rows.where(counts).select(F.when(is_left, F.col("id")).alias("left_id"), F.when(~is_left, F.col("id")).alias("right_id"))
    every = stored(met.unionByName(firsts).unionByName(alone), "positions")
    updates = (
        every.where("left_id is not null and right_id is not null")
        .groupBy("right_id")
        .agg(F.max("left_id").alias("left_id"))
        .select(F.lit("update").alias("action"), "right_id", "left_id")
    )
    others = every.where("left_id is null or right_id is null").select(
        F.when(F.col("right_id").isNull(), "delete").otherwise("create").alias("action"), F.coalesce("right_id", none).alias("right_id"), "left_id"
    )
    return updates.unionByName(others)


def zip_pairs(left: DataFrame, right: DataFrame, by: str, left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """Pair the rows of two tables by their place within a group; what is over stays alone.

    Expects ``left_id`` and ``right_id``; returns by, pos, left_id, right_id.
    """
    a = numbered(left, [by], left_order)
    b = numbered(right, [by], right_order)
    return a.select(by, "pos", "left_id").join(b.select(by, "pos", "right_id"), [by, "pos"], "full")


def capped(rows: DataFrame, by: str, order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, as a stored report keeps them."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of a sorted table; pages count from 1, sizes are kept within 1 and 200."""
    if number < 1:
        raise ValueError("pages count from 1")
    size = min(max(size, 1), 200)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One row on the pages of a table: total, page, per_page, total_pages."""
    size = min(max(size, 1), 200)
    total = F.count(F.lit(1)).alias("total")
    return rows.agg(total).select(
        "total", F.lit(number).alias("page"), F.lit(size).alias("per_page"), F.ceil(F.col("total") / size).cast("bigint").alias("total_pages")
    )


def by_action(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that update and those that create."""
    return actions.where("action = 'update'"), actions.where("action = 'create'")


def sync_order(actions: DataFrame) -> DataFrame:
    """The ids to fetch and write, updates before creates, each in the order of ids: right_id, action, place (from 1)."""
    updates, creates = by_action(actions)
    both = updates.select("right_id", "action", F.lit(0).alias("first")).unionByName(creates.select("right_id", "action", F.lit(1).alias("first")))
    return numbered(both, [], [F.col("first"), F.col("right_id")], "place").select("right_id", "action", "place")


def from_details(details: DataFrame, rows: DataFrame) -> DataFrame:
    """The plan that follows from stored groups; what a capped report left out is not planned."""
    return action_plan(Matched(details, rows))


def chunks(rows: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """Add the number of the batch of ``size`` rows that a row falls into, from 0."""
    placed = numbered(rows, [], order, "__place")
    return placed.withColumn("batch", F.floor((F.col("__place") - 1) / size).cast("bigint")).drop("__place")
