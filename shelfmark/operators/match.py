"""Two-phase matching: a stable identifier first, then the normalized title of what is left.

Sides have one row per record: ``id``, ``ord`` (place in scan order), ``title``
(normalized, not blank) and ``key`` (identifier or null). Groups are kept as
rows with a group key and counted, never gathered into lists, as one generic
title may hold a large part of either side.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfmark.functions.scalars import is_blank, normalize_title
from shelfmark.session import stored

# The six classes by the sizes of both sides of a group.
CLASSES = ("exact_1to1", "left_1_to_right_n", "left_n_to_right_1", "left_n_to_right_m", "left_only", "right_only")


class Matched(NamedTuple):
    """The outcome of matching.

    groups: group, title, n and m (rows of both sides), left_first and
    right_first (least order and id of either side), class; rows: side (l or
    r), group, id, ord of every record of both sides.
    """

    groups: DataFrame
    rows: DataFrame


def side(records: DataFrame, id: Column, title: Column, key: Column, order: Sequence[Column]) -> DataFrame:
    """The matcher's view of a table: blank titles left out, blank keys null.

    ``ord`` is the struct of the order columns, so nothing is numbered or
    sorted before it is needed.
    """
    return records.select(
        id.alias("id"),
        F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("ord"),
        normalize_title(title).alias("title"),
        F.when(~is_blank(key), F.trim(key)).alias("key"),
    ).where("title <> ''")


def first_wins(records: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every key in the given order; rows without a key all stay.

    The key is a column or several; a row has none if any of them is null. The
    rows with a key are split off, so that the window's limit of one row is
    pushed below the exchange.
    """
    keys = [key] if isinstance(key, str) else list(key)
    none = functools.reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    w = Window.partitionBy(*keys).orderBy(*order)
    firsts = records.where(~none).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return firsts.unionByName(records.where(none))


def identifier_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows with the right row of the same identifier: key, left_id, left_ord, right_id, right_ord, title.

    The right side must hold each key once; the title is the right one's.
    """
    a = left.where("key is not null").select("key", F.col("id").alias("left_id"), F.col("ord").alias("left_ord"))
    b = right.where("key is not null").select("key", F.col("id").alias("right_id"), F.col("ord").alias("right_ord"), "title")
    return a.join(b, "key")


def _aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with orders of one type, so that they can be one table: missing parts are null."""
    kinds: dict[str, T.DataType] = {}
    for field in [*left.schema["ord"].dataType.fields, *right.schema["ord"].dataType.fields]:
        known = kinds.setdefault(field.name, field.dataType)
        if known != field.dataType:
            if not isinstance(known, T.IntegralType) or not isinstance(field.dataType, T.IntegralType):
                raise ValueError(f"orders of {known} and {field.dataType} cannot be compared")
            kinds[field.name] = T.LongType()

    def cast(rows: DataFrame) -> DataFrame:
        own = rows.schema["ord"].dataType.names
        parts = (F.col(f"ord.{n}") if n in own else F.lit(None) for n in kinds)
        return rows.withColumn("ord", F.struct(*(p.cast(t).alias(n) for p, (n, t) in zip(parts, kinds.items(), strict=True))))

    return cast(left), cast(right)


def two_phase(left: DataFrame, right: DataFrame, keep: bool = False) -> Matched:
    """Match both sides in two phases.

    The right side is deduplicated by identifier, the first in scan order
    wins; ties in order go to the lesser id. A group is counted by one partial
    aggregate over both sides, so generic titles cannot skew it. With ``keep``
    the matched rows are stored, for callers that use them more than once.
    """
    left, right = _aligned(left, first_wins(right, "key", [F.col("ord"), F.col("id")]))
    pairs = identifier_pairs(left, right)
    by_key = F.concat(F.lit("k:"), F.col("key"))
    lefts1 = pairs.select(by_key.alias("group"), F.col("left_id").alias("id"), F.col("left_ord").alias("ord"), "title")
    rights1 = right.join(left.where("key is not null").select("key"), "key", "left_semi").select(by_key.alias("group"), "id", "ord", "title")
    by_title = F.concat(F.lit("t:"), F.col("title"))
    lefts2 = left.join(lefts1.select("id"), "id", "left_anti").select(by_title.alias("group"), "id", "ord", "title")
    rights2 = right.join(rights1.select("id"), "id", "left_anti").select(by_title.alias("group"), "id", "ord", "title")
    rows = (
        lefts1.unionByName(lefts2).withColumn("side", F.lit("l"))
        .unionByName(rights1.unionByName(rights2).withColumn("side", F.lit("r")))
    )
    if keep:
        rows = stored(rows, "matched")
    of = lambda side: F.when(F.col("side") == side, F.struct("ord", "id"))
    title = lambda side: F.max(F.when(F.col("side") == side, F.col("title")))
    groups = rows.groupBy("group").agg(
        # The title of a group is the right one's, if it has a right side.
        F.coalesce(title("r"), title("l")).alias("title"),
        F.count_if(F.col("side") == "l").alias("n"),
        F.count_if(F.col("side") == "r").alias("m"),
        F.min(of("l")).alias("left_first"),
        F.min(of("r")).alias("right_first"),
    )
    return Matched(classify(groups), rows.drop("title"))


def classify(groups: DataFrame) -> DataFrame:
    """Add the class of a group with n left and m right rows."""
    n, m = F.col("n"), F.col("m")
    cls = (
        F.when((n == 1) & (m == 1), CLASSES[0])
        .when((n == 1) & (m > 1), CLASSES[1])
        .when((n > 1) & (m == 1), CLASSES[2])
        .when((n > 1) & (m > 1), CLASSES[3])
        .when(m == 0, CLASSES[4])
        .otherwise(CLASSES[5])
    )
    return groups.withColumn("class", cls)


def class_counts(groups: DataFrame) -> DataFrame:
    """The number of groups of each class, zero where there is none."""
    counts = groups.agg(*(F.count_if(F.col("class") == c).alias(c) for c in CLASSES))
    pairs = F.array(*(F.struct(F.lit(c).alias("class"), F.col(c).alias("n_groups")) for c in CLASSES))
    return counts.select(F.explode(pairs).alias("x")).select("x.class", "x.n_groups")
