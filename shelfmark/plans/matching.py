"""Queries of the reconciliation pipeline: match, plan, attributes, apply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.scalars import SPACES, is_blank, normalize_title
from shelfmark.operators import apply, attributes, match, plan
from shelfmark.session import stored
from shelfmark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
CATEGORY = 12  # the forum category that mirrors the catalogue
CAP = 500  # groups of a class that a stored report keeps
ATTRIBUTES = ("issn_l", "publisher", "country", "cover_url", "cover_url_hash")


# --- Spark side -----------------------------------------------------------------------


def scope(spark: SparkSession, d: str) -> DataFrame:
    """The topics of the category that are not deleted."""
    return table(spark, d, "topics").where((F.col("category_id") == CATEGORY) & F.col("deleted_at").isNull())


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of the match: the category's topics and the catalogue's rows."""
    keys = table(spark, d, "topic_custom_fields").where("name = 'issn_l'")
    keys = attributes.last_wins(attributes.in_scope(keys, scope(spark, d), "topic_id"), "topic_id").select(
        "topic_id", F.col("value").alias("key")
    )
    topics = scope(spark, d).select("topic_id", "title").join(keys, "topic_id", "left")
    left = match.side(topics, F.col("topic_id"), F.col("title"), F.col("key"), [F.col("topic_id")])
    c = table(spark, d, "catalogue").where("unified.id is not null")
    right = match.side(
        c, F.col("unified.id"), F.col("unified.canonical_name"), F.col("unified.issn_l"), [F.col("page"), F.col("pos")]
    )
    return left, right


def matched(spark: SparkSession, d: str, keep: bool = False) -> match.Matched:
    return match.two_phase(*sides(spark, d), keep)


def groups(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).groups


def match_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return match.class_counts(groups(spark, d))


def match_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(spark, d).select("title", "n", "m", "class")


def match_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows of either side that can be matched; the right side after its deduplication."""
    left, right = sides(spark, d)
    right = match.first_wins(right, "key", [F.col("ord"), F.col("id")])
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("side"), "n_rows")
    return count(left, "left").unionByName(count(right, "right"))


def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    _, right = sides(spark, d)
    return match.first_wins(right, "key", [F.col("ord"), F.col("id")]).select("id", "title", "key")


def dedupe_lineitem(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    return match.first_wins(rows, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def title_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topics").select("topic_id", normalize_title(F.col("title")).alias("normalized"))


def identifier_match(spark: SparkSession, d: str) -> DataFrame:
    left, right = sides(spark, d)
    found = match.identifier_pairs(left, match.first_wins(right, "key", [F.col("ord"), F.col("id")]))
    return found.select(F.col("left_id").alias("topic_id"), F.col("right_id").alias("unified_id"), "title")


def _unmatched(spark: SparkSession, d: str, which: int) -> DataFrame:
    left, right = sides(spark, d)
    right = match.first_wins(right, "key", [F.col("ord"), F.col("id")])
    pairs = match.identifier_pairs(left, right)
    if which == 0:
        return left.join(pairs.select(F.col("left_id").alias("id")), "id", "left_anti").select("id", "title")
    return right.join(pairs.select(F.col("right_id").alias("id")), "id", "left_anti").select("id", "title")


def semi_in_scope(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "topic_custom_fields")
    return attributes.in_scope(fields, scope(spark, d), "topic_id").groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


def action_plan(spark: SparkSession, d: str) -> DataFrame:
    return plan.action_plan(matched(spark, d, keep=True))


def plan_counts(spark: SparkSession, d: str) -> DataFrame:
    return apply.outcome_counters(action_plan(spark, d), "action", ("update", "create", "delete"))


def details_capped(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("title"), F.coalesce("left_first.id", F.lit(0)), F.coalesce("right_first.id", F.lit(0))]
    return plan.capped(groups(spark, d), "class", order, CAP).select("class", "title", "n", "m")


def details_page(spark: SparkSession, d: str) -> DataFrame:
    only = groups(spark, d).where("class = 'left_only'").select("title", "n")
    return plan.page(only, [F.col("title")], number=2, size=50)


def zip_pairs(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("left_id")).withColumnRenamed("c_nationkey", "nation")
    right = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("right_id")).withColumnRenamed("s_nationkey", "nation")
    out = plan.zip_pairs(left, right, "nation", [F.col("left_id")], [F.col("right_id")])
    return out.select("nation", "pos", "left_id", "right_id")


def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    left, right = sides(spark, d)
    return left.where("key is not null").select("key").intersect(right.where("key is not null").select("key"))


def union_keys(spark: SparkSession, d: str) -> DataFrame:
    left, right = sides(spark, d)
    return left.select("title").unionByName(right.select("title")).distinct()


def except_keys(spark: SparkSession, d: str) -> DataFrame:
    """The scope without the one topic that describes the category itself."""
    first = scope(spark, d).agg(F.min("topic_id").alias("topic_id"))
    return scope(spark, d).select("topic_id").join(first, "topic_id", "left_anti")


def eav_pivot(spark: SparkSession, d: str) -> DataFrame:
    return attributes.pivoted(table(spark, d, "topic_custom_fields"), "topic_id", ATTRIBUTES)


def eav_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return attributes.last_wins(table(spark, d, "topic_custom_fields"), "topic_id")


def eav_maps(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct attributes each topic has, counted on its map."""
    maps = attributes.attribute_maps(table(spark, d, "topic_custom_fields"), "topic_id")
    return maps.select("topic_id", F.size("attributes").cast("bigint").alias("n_attributes"))


def eav_changed_only(spark: SparkSession, d: str) -> DataFrame:
    """What has to be written so that every topic has the last value of each attribute; stored are the first ones."""
    rows = table(spark, d, "topic_custom_fields").where("topic_id is not null")
    desired = attributes.last_wins(rows, "topic_id")
    first = attributes.last_wins(rows.withColumn("id", -F.col("id")), "topic_id").where("name <> 'cover_url'")
    return attributes.changed_only(desired, first, "topic_id")


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Parts 0 to 9 of ten are stored, parts 5 to 9 and new ones come in with changes."""
    parts = table(spark, d, "part")
    stored_rows = parts.where("p_partkey % 4 <> 0").select("p_partkey", "p_name", "p_size")
    incoming = parts.where("p_partkey % 3 = 0").select(
        "p_partkey", F.upper("p_name").alias("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 1).alias("p_size")
    )
    return apply.upsert(stored_rows, incoming, "p_partkey", keep_null=("p_size",))


def resolve_targets(spark: SparkSession, d: str) -> DataFrame:
    """For every catalogue row where it would be written, by the plan, an identifier of any topic or a title."""
    _, right = sides(spark, d)
    existing = scope(spark, d).select(F.col("topic_id").alias("id"), F.lower("title").alias("low_title"))
    # Whatever a topic's title is; the value as it is stored, every one of a topic's.
    keys = attributes.in_scope(table(spark, d, "topic_custom_fields").where("name = 'issn_l'"), scope(spark, d), "topic_id")
    existing = existing.join(keys.select(F.col("topic_id").alias("id"), F.col("value").alias("key")), "id", "left")
    planned = action_plan(spark, d).where("action = 'update'").select(F.col("right_id").alias("id"), F.col("left_id").alias("planned_id"))
    prepared = right.join(planned, "id", "left").select(
        F.concat_ws("-", "ord.o0", "ord.o1").alias("rid"), "planned_id", "key", "title"
    )
    return apply.resolve_targets(prepared, existing)


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    left = apply.cascade(
        gone,
        {
            "orders": (table(spark, d, "orders"), ["o_orderkey"]),
            "lineitem": (table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"]),
        },
    )
    count = lambda n: left[n].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
    return count("orders").unionByName(count("lineitem"))


def polymorphic_delete(spark: SparkSession, d: str) -> DataFrame:
    ids = scope(spark, d).where("topic_id % 7 = 0").select("topic_id")
    fields = table(spark, d, "topic_custom_fields")
    return apply.without_typed(fields, ids, "topic_id", "name", "cover_url").groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


def polymorphic_delete_scope(spark: SparkSession, d: str) -> DataFrame:
    """For the whole scope; :func:`polymorphic_delete` has the ids of its SQL."""
    ids = scope(spark, d).select("topic_id")
    fields = table(spark, d, "topic_custom_fields")
    return apply.without_typed(fields, ids, "topic_id", "name", "cover_url").groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


def like_delete(spark: SparkSession, d: str) -> DataFrame:
    return apply.without_like(table(spark, d, "topic_custom_fields"), "name", "cover_%").select("id", "topic_id", "name")


def delete_existing(spark: SparkSession, d: str) -> DataFrame:
    """Which of the planned deletions exist."""
    wanted = action_plan(spark, d).where("action = 'delete'").select(F.col("left_id").alias("topic_id"))
    return apply.existing_ids(wanted, table(spark, d, "topics"), "topic_id")


def category_stats(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "topics")
    posts = table(spark, d, "documents").where("topic_id is not null").select("topic_id")
    visible = F.coalesce(F.col("visible"), F.lit(False)) & F.col("deleted_at").isNull()
    return apply.category_stats(topics, posts, "category_id", "topic_id", visible)


def outcome_counters(spark: SparkSession, d: str) -> DataFrame:
    return apply.outcome_counters(upsert_merge(spark, d), "outcome", ("kept", "updated", "unchanged", "created"))


def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "catalogue").select(F.col("unified.id").alias("unified_id"), "page", "pos", F.col("unified.canonical_name").alias("title"))
    _, rejected = apply.split_valid(c, ["title"])
    return rejected.select("page", "pos", "unified_id", "reason")


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = plan.chunks(scope(spark, d).select("topic_id"), [F.col("topic_id")], 200)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n_ids"), F.min("topic_id").alias("first_id"), F.max("topic_id").alias("last_id"))


def class_percentages(spark: SparkSession, d: str) -> DataFrame:
    """The share of each class in the rows of its side."""
    g = stored(groups(spark, d).select("class", "n", "m"), "class-sizes")
    per = g.groupBy("class").agg(F.sum("n").alias("n_left"), F.sum("m").alias("n_right"))
    total = g.agg(F.sum("n").alias("t_left"), F.sum("m").alias("t_right"))
    joined = per.join(F.broadcast(total), F.lit(True))  # one row
    part = F.when(F.col("class") == "right_only", F.col("n_right")).otherwise(F.col("n_left"))
    whole = F.when(F.col("class") == "right_only", F.col("t_right")).otherwise(F.col("t_left"))
    return joined.select("class", F.round(F.when(whole > 0, part / whole * 100).otherwise(0.0), 2).alias("percent"))


def blank_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topics").where(is_blank(F.col("title"))).select("topic_id", "category_id")


# --- SQL side -------------------------------------------------------------------------


# Every reference by itself, and what lies between, so that nothing is decoded twice.
_PIECES = r"&(?:lt|gt|quot|apos|amp|#[0-9]+|#[xX][0-9A-Fa-f]+);|[^&]+|&"
_CODE = (
    r"try_cast(CASE WHEN regexp_matches(x, '^&#[0-9]+;$') THEN x[3:-2]"
    r" WHEN regexp_matches(x, '^&#[xX][0-9A-Fa-f]+;$') THEN '0x' || x[4:-2] END AS BIGINT)"
)


def unescape_sql(col: str) -> str:
    """The decoding of character references in SQL."""
    named = "CASE x WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN chr(34) WHEN '&apos;' THEN chr(39) WHEN '&amp;' THEN '&' ELSE x END"
    one = f"CASE WHEN {_CODE} BETWEEN 0 AND 55295 OR {_CODE} BETWEEN 57344 AND 1114111 THEN chr({_CODE}::INTEGER) ELSE {named} END"
    return (
        f"CASE WHEN contains({col}, '&') THEN array_to_string(list_transform(regexp_extract_all({col}, '{_PIECES}', 0, 's'),"
        f" lambda x: {one}), '') ELSE {col} END"
    )


def norm_sql(col: str) -> str:
    """The title normalization in SQL."""
    return rf"coalesce(lower(trim(regexp_replace({unescape_sql(col)}, '[\s\x{{00A0}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))), '')"


def blank_sql(col: str) -> str:
    return f"({col} IS NULL OR regexp_matches({col}, '^({SPACES})?$'))"


SCOPE = f"SELECT * FROM topics WHERE category_id = {CATEGORY} AND deleted_at IS NULL"
SIDES = f"""
scope AS ({SCOPE}),
attr AS (SELECT topic_id, value FROM (SELECT topic_id, value, row_number() OVER (PARTITION BY topic_id ORDER BY id DESC) AS rn
  FROM topic_custom_fields WHERE name = 'issn_l' AND topic_id IN (SELECT topic_id FROM scope)) WHERE rn = 1),
l AS (SELECT * FROM (SELECT s.topic_id AS id, {norm_sql("s.title")} AS title,
  CASE WHEN NOT {blank_sql("a.value")} THEN trim(a.value) END AS key
  FROM scope s LEFT JOIN attr a USING (topic_id)) WHERE title <> ''),
r0 AS (SELECT * FROM (SELECT unified.id AS id, page, pos, {norm_sql("unified.canonical_name")} AS title,
  CASE WHEN NOT {blank_sql("unified.issn_l")} THEN trim(unified.issn_l) END AS key
  FROM catalogue WHERE unified.id IS NOT NULL) WHERE title <> ''),
r AS (SELECT id, page, pos, title, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page, pos, id) AS rn FROM r0)
  WHERE key IS NULL OR rn = 1)"""
GROUPS = f"""{SIDES},
pk AS (SELECT r.key AS gk, l.id AS lid, r.id AS rid, r.title AS title FROM l JOIN r ON l.key = r.key),
g1 AS (SELECT gk, any_value(title) AS title, list_sort(list(lid)) AS ls, [any_value(rid)] AS rs FROM pk GROUP BY gk),
l2 AS (SELECT * FROM l WHERE id NOT IN (SELECT lid FROM pk)),
r2 AS (SELECT * FROM r WHERE id NOT IN (SELECT rid FROM pk)),
lt AS (SELECT title, list(id ORDER BY id) AS ls FROM l2 GROUP BY title),
rt AS (SELECT title, list(id ORDER BY page, pos, id) AS rs FROM r2 GROUP BY title),
g2 AS (SELECT coalesce(lt.title, rt.title) AS title, ls, rs FROM lt FULL JOIN rt ON lt.title = rt.title),
g0 AS (SELECT title, ls, rs FROM g1 UNION ALL SELECT title, ls, rs FROM g2),
g AS (SELECT *, coalesce(len(ls), 0) AS n, coalesce(len(rs), 0) AS m FROM g0),
c AS (SELECT *, CASE WHEN n = 1 AND m = 1 THEN 'exact_1to1' WHEN n = 1 AND m > 1 THEN 'left_1_to_right_n'
  WHEN n > 1 AND m = 1 THEN 'left_n_to_right_1' WHEN n > 1 AND m > 1 THEN 'left_n_to_right_m'
  WHEN m = 0 THEN 'left_only' ELSE 'right_only' END AS class FROM g)"""
PLAN = f"""{GROUPS},
mp AS MATERIALIZED (SELECT lid, rid, gk FROM pk),
lg AS MATERIALIZED (SELECT 'k:' || gk AS grp, lid AS id FROM (SELECT DISTINCT gk, lid FROM mp)
  UNION ALL SELECT 't:' || title, id FROM l WHERE id NOT IN (SELECT lid FROM mp)),
rg AS MATERIALIZED (SELECT 'k:' || key AS grp, id, page, pos FROM r WHERE key IN (SELECT gk FROM mp)
  UNION ALL SELECT 't:' || title, id, page, pos FROM r WHERE id NOT IN (SELECT rid FROM mp)),
ln AS MATERIALIZED (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY id) AS i FROM lg),
rn AS MATERIALIZED (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY page, pos, id) AS i FROM rg),
z AS MATERIALIZED (SELECT coalesce(ln.grp, rn.grp) AS grp, coalesce(ln.i, rn.i) AS i, ln.id AS left_id, rn.id AS right_id
  FROM ln FULL JOIN rn ON ln.grp = rn.grp AND ln.i = rn.i),
plan AS (SELECT 'update' AS action, right_id, max(left_id) AS left_id FROM z WHERE left_id IS NOT NULL AND right_id IS NOT NULL GROUP BY right_id
  UNION ALL SELECT 'delete', NULL, left_id FROM z WHERE right_id IS NULL
  UNION ALL SELECT 'create', right_id, NULL FROM z WHERE left_id IS NULL AND (i = 1 OR grp IN (SELECT grp FROM lg)))"""
CLASS_VALUES = "(VALUES " + ", ".join(f"('{c}')" for c in match.CLASSES) + ") AS v(class)"
UPSERT = """
WITH s AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 4 <> 0),
i AS (SELECT p_partkey, upper(p_name) AS p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 END AS p_size FROM part WHERE p_partkey % 3 = 0),
m AS (SELECT coalesce(s.p_partkey, i.p_partkey) AS p_partkey,
  CASE WHEN i.p_partkey IS NOT NULL THEN i.p_name ELSE s.p_name END AS p_name,
  CASE WHEN i.p_partkey IS NOT NULL THEN coalesce(i.p_size, s.p_size) ELSE s.p_size END AS p_size,
  CASE WHEN i.p_partkey IS NULL THEN 'kept' WHEN s.p_partkey IS NULL THEN 'created'
    WHEN i.p_name IS NOT DISTINCT FROM s.p_name AND coalesce(i.p_size, s.p_size) IS NOT DISTINCT FROM s.p_size THEN 'unchanged'
    ELSE 'updated' END AS outcome
  FROM s FULL JOIN i ON s.p_partkey = i.p_partkey)"""
LAST = "SELECT topic_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, name ORDER BY id DESC) AS rn FROM topic_custom_fields) WHERE rn = 1"


def _sql() -> dict[str, str]:
    unmatched = f"WITH {SIDES}, pk AS (SELECT l.id AS lid, r.id AS rid FROM l JOIN r ON l.key = r.key) "
    return {
        "match_class_counts": f"WITH {GROUPS} SELECT v.class, count(c.class) AS n_groups FROM {CLASS_VALUES} LEFT JOIN c ON c.class = v.class GROUP BY v.class",
        "match_groups": f"WITH {GROUPS} SELECT title, n, m, class FROM c",
        "match_totals": f"WITH {SIDES} SELECT 'left' AS side, count(*) AS n_rows FROM l UNION ALL SELECT 'right', count(*) FROM r",
        "dedupe_first_wins": f"WITH {SIDES} SELECT id, title, key FROM r",
        "dedupe_lineitem": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1",
        "title_normalize": f"SELECT topic_id, {norm_sql('title')} AS normalized FROM topics",
        "identifier_match": f"WITH {SIDES} SELECT l.id AS topic_id, r.id AS unified_id, r.title FROM l JOIN r ON l.key = r.key",
        "anti_unmatched_left": unmatched + "SELECT id, title FROM l WHERE id NOT IN (SELECT lid FROM pk)",
        "anti_unmatched_right": unmatched + "SELECT id, title FROM r WHERE id NOT IN (SELECT rid FROM pk)",
        "semi_in_scope": f"SELECT name, count(*) AS n_rows FROM topic_custom_fields WHERE topic_id IN (SELECT topic_id FROM ({SCOPE})) GROUP BY name",
        "action_plan": f"WITH {PLAN} SELECT action, right_id, left_id FROM plan",
        "plan_counts": f"WITH {PLAN} SELECT v.outcome, count(p.action) AS n FROM (VALUES ('update'), ('create'), ('delete')) AS v(outcome) LEFT JOIN plan p ON p.action = v.outcome GROUP BY 1",
        "details_capped": f"WITH {GROUPS} SELECT class, title, n, m FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY title, coalesce(ls[1], 0), coalesce(rs[1], 0)) AS rn FROM c) WHERE rn <= {CAP}",
        "details_page": f"WITH {GROUPS} SELECT title, n FROM c WHERE class = 'left_only' ORDER BY title LIMIT 50 OFFSET 50",
        "zip_pairs": "WITH a AS (SELECT c_nationkey AS nation, c_custkey AS left_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer), b AS (SELECT s_nationkey AS nation, s_suppkey AS right_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos FROM supplier) SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.pos, b.pos) AS pos, left_id, right_id FROM a FULL JOIN b ON a.nation = b.nation AND a.pos = b.pos",
        "intersect_keys": f"WITH {SIDES} SELECT key FROM l WHERE key IS NOT NULL INTERSECT SELECT key FROM r0 WHERE key IS NOT NULL",
        "union_keys": f"WITH {SIDES} SELECT title FROM l UNION SELECT title FROM r0",
        "except_keys": f"SELECT topic_id FROM ({SCOPE}) EXCEPT SELECT min(topic_id) FROM ({SCOPE})",
        "eav_pivot": f"SELECT topic_id, {', '.join(f'max(CASE WHEN name = {chr(39)}{a}{chr(39)} THEN value END) AS {a}' for a in ATTRIBUTES)} FROM ({LAST}) GROUP BY topic_id",
        "eav_last_wins": LAST,
        "eav_maps": "SELECT topic_id, count(DISTINCT name) AS n_attributes FROM topic_custom_fields GROUP BY topic_id",
        "eav_changed_only": f"WITH d AS ({LAST}), f AS (SELECT topic_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, name ORDER BY id) AS rn FROM topic_custom_fields) WHERE rn = 1 AND name <> 'cover_url') SELECT d.topic_id, d.name, d.value, CASE WHEN f.topic_id IS NULL THEN 'insert' ELSE 'replace' END AS change FROM d LEFT JOIN f ON d.topic_id = f.topic_id AND d.name = f.name WHERE d.topic_id IS NOT NULL AND NOT {blank_sql('d.value')} AND (f.topic_id IS NULL OR f.value IS DISTINCT FROM d.value)",
        "upsert_merge": f"{UPSERT} SELECT p_partkey, p_name, p_size, outcome FROM m",
        "resolve_targets": f"WITH {PLAN}, k AS (SELECT value AS key, min(topic_id) AS id FROM topic_custom_fields WHERE name = 'issn_l' AND value IS NOT NULL AND topic_id IN (SELECT topic_id FROM scope) GROUP BY 1), t AS (SELECT lower(title) AS low_title, min(topic_id) AS id FROM scope WHERE title IS NOT NULL GROUP BY 1), u AS (SELECT right_id, left_id FROM plan WHERE action = 'update') SELECT r0.page || '-' || r0.pos AS rid, coalesce(u.left_id, k.id, t.id) AS target_id, CASE WHEN u.left_id IS NOT NULL THEN 'plan' WHEN k.id IS NOT NULL THEN 'key' WHEN t.id IS NOT NULL THEN 'title' ELSE 'new' END AS found_by FROM r0 LEFT JOIN u ON u.right_id = r0.id LEFT JOIN k ON k.key = r0.key LEFT JOIN t ON t.low_title = r0.title",
        "cascade_delete": "WITH g AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P') SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders WHERE o_orderkey NOT IN (SELECT id FROM g) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g) AND l_partkey NOT IN (SELECT id FROM g)",
        "polymorphic_delete": f"SELECT name, count(*) AS n_rows FROM topic_custom_fields WHERE NOT (coalesce(name, '') = 'cover_url' AND coalesce(topic_id, -1) IN (SELECT topic_id FROM ({SCOPE}) WHERE topic_id % 7 = 0)) GROUP BY name",
        "polymorphic_delete_scope": f"SELECT name, count(*) AS n_rows FROM topic_custom_fields WHERE NOT (coalesce(name, '') = 'cover_url' AND coalesce(topic_id, -1) IN (SELECT topic_id FROM ({SCOPE}))) GROUP BY name",
        "like_delete": "SELECT id, topic_id, name FROM topic_custom_fields WHERE NOT coalesce(name LIKE 'cover_%', false)",
        "delete_existing": f"WITH {PLAN} SELECT left_id AS topic_id FROM plan WHERE action = 'delete' AND left_id IN (SELECT topic_id FROM topics)",
        "category_stats": "WITH t AS (SELECT category_id, topic_id, coalesce(visible, false) AND deleted_at IS NULL AS v FROM topics), p AS (SELECT category_id, count(*) AS n FROM documents d JOIN t USING (topic_id) WHERE t.v GROUP BY category_id) SELECT t.category_id, count(*) FILTER (WHERE v) AS n_topics, coalesce(any_value(p.n), 0) AS n_posts FROM t LEFT JOIN p ON p.category_id = t.category_id GROUP BY t.category_id",
        "outcome_counters": f"{UPSERT} SELECT v.outcome, count(m.outcome) AS n FROM (VALUES ('kept'), ('updated'), ('unchanged'), ('created')) AS v(outcome) LEFT JOIN m ON m.outcome = v.outcome GROUP BY 1",
        "quarantine_split": f"SELECT page, pos, unified.id AS unified_id, 'title missing' AS reason FROM catalogue WHERE {blank_sql('unified.canonical_name')}",
        "chunk_ids": f"SELECT batch, count(*) AS n_ids, min(topic_id) AS first_id, max(topic_id) AS last_id FROM (SELECT topic_id, (row_number() OVER (ORDER BY topic_id) - 1) // 200 AS batch FROM ({SCOPE})) GROUP BY batch",
        "class_percentages": f"WITH {GROUPS}, t AS (SELECT sum(n) AS tl, sum(m) AS tr FROM c) SELECT class, round(CASE WHEN class = 'right_only' THEN sum(m)::DOUBLE / any_value(t.tr) * 100 ELSE sum(n)::DOUBLE / any_value(t.tl) * 100 END, 2) AS percent FROM c, t GROUP BY class",
        "blank_titles": f"SELECT topic_id, category_id FROM topics WHERE {blank_sql('title')}",
    }


def queries() -> dict[str, Query]:
    named = (
        match_class_counts, match_groups, match_totals, dedupe_first_wins, dedupe_lineitem, title_normalize, identifier_match,
        semi_in_scope, action_plan, plan_counts, details_capped, details_page, zip_pairs, intersect_keys, union_keys,
        except_keys, eav_pivot, eav_last_wins, eav_maps, eav_changed_only, upsert_merge, resolve_targets, cascade_delete,
        polymorphic_delete, polymorphic_delete_scope, like_delete, delete_existing, category_stats, outcome_counters, quarantine_split, chunk_ids,
        class_percentages, blank_titles,
    )
    out: dict[str, Query] = {f.__name__: f for f in named}
    out["anti_unmatched_left"] = lambda spark, d: _unmatched(spark, d, 0)
    out["anti_unmatched_right"] = lambda spark, d: _unmatched(spark, d, 1)
    return out


def oracle_sql() -> dict[str, str]:
    return _sql()
