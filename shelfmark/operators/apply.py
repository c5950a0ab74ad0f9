"""Applying a plan: targets, upserts, cascading deletes, counters and rejected rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalars import is_blank


def resolve_targets(prepared: DataFrame, existing: DataFrame) -> DataFrame:
    """Find the stored record that each prepared one updates.

    ``prepared`` has rid, planned_id, key, title (normalized); ``existing`` has
    id, key, low_title (lower case only). A planned id comes first, then the
    least stored id with the key, then the least with the title. Adds
    ``target_id`` (null: insert) and ``found_by``.
    """
    by_key = existing.where("key is not null").groupBy("key").agg(F.min("id").alias("key_id"))
    by_title = existing.where("low_title is not null").groupBy(F.col("low_title").alias("title")).agg(F.min("id").alias("title_id"))
    out = prepared.join(by_key, "key", "left").join(by_title, "title", "left")
    found = (
        F.when(F.col("planned_id").isNotNull(), "plan")
        .when(F.col("key_id").isNotNull(), "key")
        .when(F.col("title_id").isNotNull(), "title")
        .otherwise("new")
    )
    return out.select("rid", F.coalesce("planned_id", "key_id", "title_id").alias("target_id"), found.alias("found_by"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, keep_null: Sequence[str] = ()) -> DataFrame:
    """Join-and-rewrite merge: matched rows take the incoming values, others stay or are added.

    Columns in ``keep_null`` keep the stored value where the incoming one is
    null. Adds ``outcome``: kept, updated, unchanged or created. The incoming
    table must hold each key once; applying it twice changes nothing more.
    """
    values = [c for c in stored.columns if c != key]
    a = stored.select(key, *(F.col(c).alias(f"__old_{c}") for c in values), F.lit(True).alias("__a"))
    b = incoming.select(key, *(F.col(c).alias(f"__new_{c}") for c in values), F.lit(True).alias("__b"))
    both = a.join(b, key, "full")
    there, given = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    new = {c: F.coalesce(F.col(f"__new_{c}"), F.col(f"__old_{c}")) if c in keep_null else F.col(f"__new_{c}") for c in values}
    same = F.lit(True)
    for c in values:
        same = same & new[c].eqNullSafe(F.col(f"__old_{c}"))
    outcome = F.when(there & ~given, "kept").when(~there, "created").when(same, "unchanged").otherwise("updated")
    return both.select(key, *(F.when(given, new[c]).otherwise(F.col(f"__old_{c}")).alias(c) for c in values), outcome.alias("outcome"))


def written(stored: DataFrame, actions: DataFrame, prepared: DataFrame, now: Column, close: bool = True) -> DataFrame:
    """The stored records after a plan was carried out, with ``outcome``.

    ``stored`` has id, title, closed, updated_at; ``prepared`` has right_id,
    title, each right_id once. An update takes the new title only if it
    differs, which ``title_changed`` tells, and always touches updated_at; a
    prepared record without a title fails and changes nothing. Created records
    have no id yet. ``close`` closes what is written. Deleted records go.
    """
    new = actions.join(prepared.select("right_id", F.col("title").alias("new_title")), "right_id", "left").where("action <> 'delete'")
    new = new.withColumn("valid", ~is_blank(F.col("new_title")))
    # Several right ids may update one stored record; the greatest is written last.
    updates = (
        new.where("action = 'update' and valid").groupBy(F.col("left_id").alias("id")).agg(F.max_by("new_title", "right_id").alias("new_title"))
    )
    gone = actions.where("action = 'delete'").select(F.col("left_id").alias("id"))
    old = stored.join(gone, "id", "left_anti").join(updates, "id", "left")
    hit = F.col("new_title").isNotNull()
    differs = hit & ~F.col("title").eqNullSafe(F.col("new_title"))
    shut = F.lit(True) if close else F.col("closed")
    kept = old.select(
        "id", F.when(differs, F.col("new_title")).otherwise(F.col("title")).alias("title"), F.when(hit, shut).otherwise(F.col("closed")).alias("closed"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"), differs.alias("title_changed"), F.when(hit, "updated").otherwise("kept").alias("outcome"),
    )
    none = F.lit(None).cast(stored.schema["id"].dataType)
    made = new.where("action = 'create' and valid").select(
        none.alias("id"), F.col("new_title").alias("title"), F.lit(close).alias("closed"), now.alias("updated_at"), F.lit(False).alias("title_changed"), F.lit("created").alias("outcome")
    )
    return kept.unionByName(made)


def existing_ids(ids: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """The requested ids that exist."""
    return ids.join(table.select(on), on, "left_semi")


def cascade(ids: DataFrame, tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> dict[str, DataFrame]:
    """Delete the ids from every dependent table: what is left of each, by name.

    Each table comes with the columns that refer to the ids; a row goes if any
    of them does. One anti-join per column, so that no OR turns the join into
    a nested loop.
    """
    key = ids.columns[0]
    out = {}
    for name, (table, columns) in tables.items():
        for c in columns:
            table = table.join(ids.select(F.col(key).alias(c)), c, "left_anti")
        out[name] = table
    return out


def without_typed(rows: DataFrame, ids: DataFrame, id_col: str, type_col: str, type_name: str) -> DataFrame:
    """Polymorphic delete: rows of one type whose target is among the ids go."""
    key = ids.columns[0]
    gone = ids.select(F.col(key).alias("__gone"))
    return rows.join(gone, (F.col(type_col) == type_name) & (F.col(id_col) == F.col("__gone")), "left_anti")


def without_like(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column does not match a LIKE pattern; nulls stay."""
    return rows.where(~F.coalesce(F.col(column).like(pattern), F.lit(False)))


def category_stats(topics: DataFrame, posts: DataFrame, category: str, topic: str, visible: Column) -> DataFrame:
    """Visible topics and posts per category, zero-filled over the categories of the topics."""
    t = topics.groupBy(category).agg(F.count_if(visible).alias("n_topics"))
    p = posts.join(topics.where(visible).select(topic, category), topic).groupBy(category).agg(F.count(F.lit(1)).alias("n_posts"))
    return t.join(p, category, "left").select(category, "n_topics", F.coalesce("n_posts", F.lit(0)).alias("n_posts"))


def outcome_counters(rows: DataFrame, outcome: str, outcomes: Sequence[str]) -> DataFrame:
    """How many rows had each outcome, zero where none had: outcome, n."""
    one = rows.agg(*(F.count_if(F.col(outcome) == o).alias(o) for o in outcomes))
    pairs = F.array(*(F.struct(F.lit(o).alias("outcome"), F.col(o).alias("n")) for o in outcomes))
    return one.select(F.explode(pairs).alias("x")).select("x.outcome", "x.n")


def split_valid(rows: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required texts, and the others with the first reason against them."""
    reason = F.coalesce(*(F.when(is_blank(F.col(c)), F.lit(f"{c} missing")) for c in required))
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
