"""Related records: shared tags, publisher and country as one score, best first."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfmark.session import stored

# What a shared tag, the same publisher and the same country count.
WEIGHTS = {"tags": 3, "publisher": 2, "country": 1}


def related_to_one(
    items: DataFrame, tags: DataFrame, id_value: int, k: int = 5, criteria: Sequence[str] = ("tags", "publisher"), visible: Column | None = None
) -> DataFrame:
    """The ``k`` best related items of one item: other_id, score, best first.

    ``items`` has id, publisher, country, recency; ``tags`` has id, tag. Ties
    go to the more recent, then to the lesser id.
    """
    pool = items if visible is None else items.where(visible)
    me = items.where(F.col("id") == id_value).select(F.col("publisher").alias("p"), F.col("country").alias("c"))
    own = tags.where(F.col("id") == id_value).select("tag").distinct()
    others = tags.where(F.col("id") != id_value).join(own, "tag")
    counted = others.groupBy("id").agg((F.count(F.lit(1)) * WEIGHTS["tags"]).alias("tag_points"))
    same = F.lit(0)
    if "publisher" in criteria:
        same = same + F.when(F.col("publisher") == F.col("p"), WEIGHTS["publisher"]).otherwise(0)
    if "country" in criteria:
        same = same + F.when(F.col("country") == F.col("c"), WEIGHTS["country"]).otherwise(0)
    # One row on the right: the item itself.
    scored = pool.where(F.col("id") != id_value).join(F.broadcast(me.limit(1)), F.lit(True), "left")
    points = same
    if "tags" in criteria:
        scored = scored.join(counted, "id", "left")
        points = same + F.coalesce("tag_points", F.lit(0))
    return (
        scored.select(F.col("id").alias("other_id"), points.cast("bigint").alias("score"), "recency")
        .where("score > 0")
        .orderBy(F.desc("score"), F.desc_nulls_last("recency"), "other_id")
        .limit(k)
        .select("other_id", "score")
    )


MOST_FEATURES = 10  # of a profile, for which all combinations are listed
ASKING, BLOCK = 100_000, 400_000  # features of the profiles, and of the items, that one task scores against each other


def _best_of_block(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores profiles against a block of items; only the ``most`` best items of each profile leave it."""

    def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        one = pa.concat_arrays(lists.chunks)
        return one.flatten().to_numpy(zero_copy_only=False), one.value_lengths().to_numpy(zero_copy_only=False)

    def best(asking: pa.Table, block: pa.Table) -> pa.Table:
        rows, places, scores = [], [], []
        if asking.num_rows and block.num_rows:
            block, n = block.sort_by("place"), block.num_rows
            codes, sizes = flat(block["codes"])
            owners = np.repeat(np.arange(n), sizes)[np.argsort(codes, kind="stable")]
            known, lengths = np.unique(codes, return_counts=True)
            starts = np.cumsum(lengths) - lengths
            wanted, sizes = flat(asking["codes"])
            points, ends = flat(asking["points"])[0], np.cumsum(sizes)
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            there = known[at] == wanted
            for i, (low, high) in enumerate(zip(ends - sizes, ends, strict=True)):
                mine = there[low:high]
                if not mine.any():
                    continue
                found = at[low:high][mine]
                holders = np.concatenate([owners[starts[f] : starts[f] + lengths[f]] for f in found])
                total = np.bincount(holders, np.repeat(points[low:high][mine], lengths[found]), n)
                near = np.flatnonzero(total > 0)
                value = total[near].astype(np.int64)
                if len(near) > most:  # of equal scores the earlier place
                    top = np.argpartition(near - value * n, most - 1)[:most]
                    near, value = near[top], value[top]
                rows.append(np.full(len(near), i))
                places.append(near)
                scores.append(value)
        joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        of, to = asking.take(pa.array(joined(rows))), block.take(pa.array(joined(places)))
        return pa.table({"profile": of["profile"], "other_id": to["other_id"], "score": pa.array(joined(scores)), "recency": to["recency"]})

    return best


def _best_by_blocks(asking: DataFrame, others: DataFrame, most: int) -> DataFrame:
    """The best of ``others`` for the profiles in ``asking``: profile, other_id, score, recency; ``most`` of each block.

    Both are cut into parts of bounded size, and each part of one meets each of
    the other in a task that keeps all but the best to itself. So the pairs cost
    time but neither disk nor memory.
    """
    parts = lambda df, size: max(1, math.ceil((df.agg(F.sum(F.size("codes"))).first()[0] or 0) / size))
    chunks, blocks = parts(asking, ASKING), parts(others, BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asking.select("profile", "codes", "points", F.pmod(F.xxhash64("profile"), F.lit(chunks)).cast("int").alias("chunk"), every(blocks).alias("block"))
    o = others.withColumn("block", F.pmod(F.xxhash64("other_id"), F.lit(blocks)).cast("int"))
    o = o.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(F.desc_nulls_last("recency"), "other_id")))
    o = o.select("other_id", "recency", "codes", "place", "block", every(chunks).alias("chunk"))
    schema = T.StructType(
        [T.StructField("profile", T.LongType()), others.schema["other_id"], T.StructField("score", T.LongType()), others.schema["recency"]]
    )
    return a.groupBy("chunk", "block").cogroup(o.groupBy("chunk", "block")).applyInArrow(_best_of_block(most), schema)


def related_to_all(items: DataFrame, features: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best related items of every item: id, other_id, score, place.

    ``features`` has id, feature, points: what two items share is worth the
    points. Items with equal features are collapsed to one profile first.

    A profile of up to MOST_FEATURES features is listed under each combination
    of them, and only the ``k`` + 1 most recent items under a combination are
    kept: whoever shares just that combination and is older has ``k`` better
    ones before it. So a feature that a third of all items have costs one row
    per item, not all pairs of them. Pairs with a richer profile are scored over
    the features that they share, part by part; that holds for those pairs only.
    """
    profiles = features.groupBy("id").agg(
        F.array_sort(F.collect_set(F.struct("feature", "points"))).alias("features")
    ).withColumn("profile", F.xxhash64("features"))
    profiles = stored(profiles.join(items.select("id", "recency"), "id"), "profiles")
    members = profiles.select("id", "profile", "recency")
    newest = (F.desc_nulls_last("recency"), "id")
    ranked = members.withColumn("m", F.row_number().over(Window.partitionBy("profile").orderBy(*newest))).where(F.col("m") <= k + 1)
    flat = stored(profiles.groupBy("profile").agg(F.any_value("features").alias("features")), "flat-profiles")
    rich = F.size("features") > MOST_FEATURES
    listed = F.expr(
        "transform(sequence(1, shiftleft(1, size(features)) - 1),"
        " mask -> filter(features, (x, i) -> (shiftright(mask, i) & 1) = 1))"
    )
    subsets = flat.where(~rich).select("profile", F.explode(listed).alias("s"))
    keyed = subsets.select(
        "profile",
        F.xxhash64(F.transform("s", lambda x: x["feature"])).alias("combination"),
        F.aggregate("s", F.lit(0).cast("bigint"), lambda total, x: total + x["points"]).alias("score"),
    )
    under = keyed.select("combination", "profile").join(ranked.select("profile", F.col("id").alias("other_id"), "recency"), "profile")
    first = Window.partitionBy("combination").orderBy(F.desc_nulls_last("recency"), "other_id")
    tops = under.withColumn("t", F.row_number().over(first)).where(F.col("t") <= k + 1).select("combination", "other_id", "recency")
    # The greatest score under which two meet is that of all they share.
    poor = keyed.join(tops, "combination").groupBy("profile", "other_id").agg(F.max("score").alias("score"), F.any_value("recency").alias("recency"))
    # A feature of which nothing is known is shared with no one.
    some = F.filter("features", lambda x: x["feature"].isNotNull())
    coded = flat.select(
        "profile", F.transform(some, lambda x: F.xxhash64(x["feature"])).alias("codes"), F.transform(some, lambda x: x["points"].cast("bigint")).alias("points"), rich.alias("rich")
    )
    cand = poor
    if not coded.where("rich").isEmpty():
        holders = stored(ranked.select("profile", F.col("id").alias("other_id"), "recency").join(coded.drop("points"), "profile"), "holders")
        # A poor profile meets the rich ones' items, a rich one all; blocks of poor items hold no long lists.
        for asks, holds in (("rich", "rich"), ("rich", "not rich"), ("not rich", "rich")):
            cand = cand.unionByName(_best_by_blocks(coded.where(asks), holders.where(holds), k + 1))
    cand = cand.where("score > 0")
    # For each profile the best over all; one more than k, as one may be the item itself.
    best = Window.partitionBy("profile").orderBy(F.desc("score"), F.desc_nulls_last("recency"), "other_id")
    top = cand.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    mine = members.select("id", "profile").join(top.select("profile", "other_id", "score", "recency"), "profile").where("id <> other_id")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.desc_nulls_last("recency"), "other_id"))
    return mine.withColumn("place", place).where(F.col("place") <= k).select("id", "other_id", "score", "place")


def in_order(rows: DataFrame, ids: Sequence[int], id_col: str) -> DataFrame:
    """The rows of a short list of ids, in the list's order."""
    wanted = F.array(*(F.lit(i) for i in ids))
    return rows.where(F.col(id_col).isin(*ids)).orderBy(F.array_position(wanted, F.col(id_col)))
