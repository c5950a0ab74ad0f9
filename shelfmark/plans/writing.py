"""Queries on carrying out plans, paging, searching and related topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import scalars as s
from shelfmark.operators import apply, attributes, derive, match, plan, related, runs
from shelfmark.plans import matching as m
from shelfmark.session import scratch_folder
from shelfmark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
NOW = "2025-06-01 00:00:00"


def plan_written(spark: SparkSession, d: str) -> DataFrame:
    """The scope's topics after the plan was carried out."""
    c = table(spark, d, "catalogue").where("unified.id is not null")
    names = match.first_wins(
        c.select(F.col("unified.id").alias("right_id"), F.col("unified.canonical_name").alias("title"), "page", "pos"), "right_id", [F.col("page"), F.col("pos")]
    )
    stored = m.scope(spark, d).select(F.col("topic_id").alias("id"), "title", "closed", "updated_at")
    return apply.written(stored, m.action_plan(spark, d), names, F.expr(f"timestamp_ntz'{NOW}'"))


def sync_order(spark: SparkSession, d: str) -> DataFrame:
    return plan.sync_order(m.action_plan(spark, d))


def plan_from_details(spark: SparkSession, d: str) -> DataFrame:
    """The plan that follows from the stored report of groups."""
    matched = m.matched(spark, d, keep=True)
    order = [F.col("title"), F.coalesce("left_first.id", F.lit(0)), F.coalesce("right_first.id", F.lit(0))]
    return plan.from_details(plan.capped(matched.groups, "class", order, m.CAP), matched.rows)


def page_totals(spark: SparkSession, d: str) -> DataFrame:
    return plan.page_totals(m.groups(spark, d).where("class = 'left_only'"), 2, 50)


def run_results(spark: SparkSession, d: str) -> DataFrame:
    """A run of two parts, written, broken off and resumed: the counters of its plan."""
    base = scratch_folder(spark, "runs")
    first = {"plan": lambda: m.action_plan(spark, d)}
    runs.save(spark, base, "run-1", first)
    counters = lambda: apply.outcome_counters(runs.load(spark, base, "run-1", "plan"), "action", ("update", "create", "delete"))
    return runs.save(spark, base, "run-1", first | {"counters": counters})["counters"]


def category_exists(spark: SparkSession, d: str) -> DataFrame:
    """Every category and whether it has any visible topic."""
    t = table(spark, d, "topics").where("category_id is not null")
    some = t.where("visible and deleted_at is null").select("category_id").distinct().withColumn("has_topics", F.lit(True))
    return t.select("category_id").distinct().join(some, "category_id", "left").select("category_id", F.coalesce("has_topics", F.lit(False)).alias("has_topics"))


def follow_up_ids(spark: SparkSession, d: str) -> DataFrame:
    """The distinct topics of the scope with a cover, in batches of 500."""
    f = table(spark, d, "topic_custom_fields").where("name = 'cover_url' and value is not null")
    ids = attributes.in_scope(f, m.scope(spark, d), "topic_id").select("topic_id").distinct()
    return plan.chunks(ids, [F.col("topic_id")], 500)


def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    """Each topic's attributes over those that the topic is known by itself."""
    maps = attributes.attribute_maps(table(spark, d, "topic_custom_fields").where("name <> 'data' and topic_id is not null"), "topic_id")
    t = table(spark, d, "topics").select("topic_id", F.create_map(F.lit("title"), F.col("title"), F.lit("country"), F.lit("none")).alias("own"))
    both = t.join(maps, "topic_id", "left").withColumn("m", attributes.merged_maps(F.col("own"), F.col("attributes")))
    return both.select("topic_id", F.size("m").cast("bigint").alias("n"), F.try_element_at("m", F.lit("title")).alias("title"), F.try_element_at("m", F.lit("country")).alias("country"), F.try_element_at("m", F.lit("issn_l")).alias("issn_l"))


def _categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topics").select("category_id", (F.col("category_id") % 3 == 1).alias("restricted")).distinct()


def sitemap_listed(spark: SparkSession, d: str) -> DataFrame:
    listed = derive.listed(table(spark, d, "topics"), _categories(spark, d), "category_id")
    return derive.sitemap_page(listed, 1, 100).select("topic_id", "category_id")


def sitemap_news(spark: SparkSession, d: str) -> DataFrame:
    """What was bumped within 72 hours before the reference instant."""
    listed = derive.listed(table(spark, d, "topics"), _categories(spark, d), "category_id")
    return derive.sitemap_recent(listed, F.expr(f"timestamp_ntz'{NOW}' - interval 72 hours")).select("topic_id", "bumped_at")


def search_top8(spark: SparkSession, d: str) -> DataFrame:
    return derive.search(table(spark, d, "topics"), "title", "Review", 8).select("topic_id", "title")


def untreated_documents(spark: SparkSession, d: str) -> DataFrame:
    return derive.without_marker(table(spark, d, "documents"), "text", "<").select("doc_id")


def path_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids in paths of topics, upper case and lower, and in paths of other kinds."""
    t = table(spark, d, "topics").select("topic_id")
    kind = F.element_at(F.array(F.lit("/t/a-title/"), F.lit("/T/x/"), F.lit("/c/a-title/"), F.lit("/t/")), (F.col("topic_id") % 4 + 1).cast("int"))
    return t.select("topic_id", s.url_record_id(F.concat(kind, F.col("topic_id"), F.lit("?page=2"))).alias("found"))


def settings_split(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(s.split_setting(F.concat("p_brand", F.lit(" ,"), "p_name", F.lit("| , "), "p_type")), ";").alias("items"))


def labels_localized(spark: SparkSession, d: str) -> DataFrame:
    """Labels of regions in two languages, with a value in them and with fallbacks."""
    labels = {"en": {"r0": "Region %{name}", "r1": "Area %{name}", "r2": "%{name}"}, "zh": {"r0": "地区 %{name}"}}
    r = table(spark, d, "region")
    key, lang = F.concat(F.lit("r"), F.col("r_regionkey") % 4), F.when(F.col("r_regionkey") % 2 == 0, "zh").otherwise("en")
    return r.select("r_regionkey", s.localized(key, lang, labels, "en", name=F.col("r_name")).alias("label"))


def tri_state(spark: SparkSession, d: str) -> DataFrame:
    """Texts of customers as flags: '1' is true, null unknown, everything else false."""
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, None).when(k % 5 == 1, "1").when(k % 5 == 2, "true").when(k % 5 == 3, "0").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", s.tri_state(text).alias("flag"))


def _topic_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The listed topics of the scope with publisher and country, and the kinds of their documents as tags."""
    wide = attributes.pivoted(table(spark, d, "topic_custom_fields"), "topic_id", ("publisher", "country"))
    t = m.scope(spark, d).where("visible and archetype = 'regular'").join(wide, "topic_id", "left")
    items = t.select(F.col("topic_id").alias("id"), "publisher", "country", F.col("bumped_at").alias("recency"))
    docs = table(spark, d, "documents").where("topic_id is not null").select(F.col("topic_id").alias("id"), F.concat_ws(":", "kind", "lang").alias("tag")).distinct()
    return items, docs.join(items.select("id"), "id", "left_semi")


def related_topics(spark: SparkSession, d: str) -> DataFrame:
    """The five topics most like each listed topic of the scope, by tags, publisher and country."""
    items, tags = _topic_items(spark, d)
    of = lambda c, points: items.where(~s.is_blank(F.col(c))).select("id", F.concat(F.lit(f"{c}:"), c).alias("feature"), F.lit(points).alias("points"))
    tagged = tags.select("id", F.concat(F.lit("tag:"), "tag").alias("feature"), F.lit(related.WEIGHTS["tags"]).alias("points"))
    features = tagged.unionByName(of("publisher", related.WEIGHTS["publisher"])).unionByName(of("country", related.WEIGHTS["country"]))
    return related.related_to_all(items, features, k=5).select("id", "other_id", F.col("score").cast("bigint").alias("score"), F.col("place").cast("bigint").alias("place"))


def _sql() -> dict[str, str]:
    categories = "(SELECT DISTINCT category_id, category_id % 3 = 1 AS restricted FROM topics)"
    listed = f"topics JOIN {categories} g USING (category_id) WHERE NOT restricted AND visible AND deleted_at IS NULL"
    last = "SELECT topic_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, name ORDER BY id DESC) AS rn FROM topic_custom_fields WHERE topic_id IS NOT NULL) WHERE rn = 1"
    capped = f"d AS MATERIALIZED (SELECT CASE WHEN gk IS NULL THEN 't:' || title ELSE 'k:' || gk END AS grp FROM (SELECT gk, title, class, row_number() OVER (PARTITION BY class ORDER BY title, coalesce(ls[1], 0), coalesce(rs[1], 0)) AS k FROM cc) WHERE k <= {m.CAP})"
    keyed = (
        "cc AS (SELECT *, CASE WHEN n = 1 AND m = 1 THEN 'exact_1to1' WHEN n = 1 AND m > 1 THEN 'left_1_to_right_n' WHEN n > 1 AND m = 1 THEN 'left_n_to_right_1' WHEN n > 1 AND m > 1 THEN 'left_n_to_right_m'"
        " WHEN m = 0 THEN 'left_only' ELSE 'right_only' END AS class FROM (SELECT *, coalesce(len(ls), 0) AS n, coalesce(len(rs), 0) AS m FROM"
        " (SELECT gk, title, ls, rs FROM g1 UNION ALL SELECT NULL, title, ls, rs FROM g2)))"
    )
    tags = "(SELECT DISTINCT topic_id AS id, 'tag:' || concat_ws(':', kind, lang) AS f, 3 AS pts FROM documents WHERE topic_id IS NOT NULL)"
    items = f"(SELECT topic_id AS id, bumped_at AS recency FROM ({m.SCOPE}) WHERE visible AND archetype = 'regular')"
    own = f"SELECT topic_id AS id, name || ':' || value AS f, CASE name WHEN 'publisher' THEN 2 ELSE 1 END AS pts FROM ({last}) WHERE name IN ('publisher', 'country') AND NOT {m.blank_sql('value')}"
    names = "SELECT right_id, title FROM (SELECT unified.id AS right_id, unified.canonical_name AS title, row_number() OVER (PARTITION BY unified.id ORDER BY page, pos) AS rn FROM catalogue WHERE unified.id IS NOT NULL) WHERE rn = 1"
    return {
        "plan_written": f"WITH {m.PLAN}, nm AS ({names}), ok AS (SELECT plan.*, nm.title AS nt FROM plan JOIN nm USING (right_id) WHERE action <> 'delete' AND NOT {m.blank_sql('nm.title')}),"
        " up AS (SELECT left_id AS id, arg_max(nt, right_id) AS nt FROM ok WHERE action = 'update' GROUP BY 1)"
        f" SELECT s.topic_id AS id, coalesce(up.nt, s.title) AS title, CASE WHEN up.nt IS NOT NULL THEN true ELSE closed END AS closed, CASE WHEN up.nt IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at,"
        " up.nt IS NOT NULL AND up.nt IS DISTINCT FROM s.title AS title_changed, CASE WHEN up.nt IS NOT NULL THEN 'updated' ELSE 'kept' END AS outcome"
        " FROM scope s LEFT JOIN up ON up.id = s.topic_id WHERE s.topic_id NOT IN (SELECT left_id FROM plan WHERE action = 'delete')"
        f" UNION ALL SELECT NULL, nt, true, TIMESTAMP '{NOW}', false, 'created' FROM ok WHERE action = 'create'",
        "sync_order": f"WITH {m.PLAN} SELECT right_id, action, row_number() OVER (ORDER BY CASE action WHEN 'update' THEN 0 ELSE 1 END, right_id) AS place FROM plan WHERE action <> 'delete'",
        "plan_from_details": f"WITH {m.PLAN}, {keyed}, {capped}, zz AS (SELECT * FROM z WHERE grp IN (SELECT grp FROM d)) SELECT 'update' AS action, right_id, max(left_id) AS left_id FROM zz WHERE left_id IS NOT NULL AND right_id IS NOT NULL GROUP BY right_id UNION ALL SELECT 'delete', NULL, left_id FROM zz WHERE right_id IS NULL UNION ALL SELECT 'create', right_id, NULL FROM zz WHERE left_id IS NULL AND (i = 1 OR grp IN (SELECT grp FROM lg))",
        "page_totals": f"WITH {m.GROUPS} SELECT count(*) AS total, 2 AS page, 50 AS per_page, ceil(count(*) / 50.0)::BIGINT AS total_pages FROM c WHERE class = 'left_only'",
        "run_results": f"WITH {m.PLAN} SELECT v.outcome, count(p.action) AS n FROM (VALUES ('update'), ('create'), ('delete')) AS v(outcome) LEFT JOIN plan p ON p.action = v.outcome GROUP BY 1",
        "category_exists": "SELECT category_id, bool_or(coalesce(visible, false) AND deleted_at IS NULL) AS has_topics FROM topics WHERE category_id IS NOT NULL GROUP BY 1",
        "follow_up_ids": f"SELECT topic_id, (row_number() OVER (ORDER BY topic_id) - 1) // 500 AS batch FROM (SELECT DISTINCT topic_id FROM topic_custom_fields WHERE name = 'cover_url' AND value IS NOT NULL AND topic_id IN (SELECT topic_id FROM ({m.SCOPE})))",
        "merged_maps": f"WITH v AS (SELECT * FROM ({last}) WHERE name <> 'data') SELECT t.topic_id, 2 + count(v.name) FILTER (WHERE v.name <> 'country') AS n, t.title, CASE WHEN count(*) FILTER (WHERE v.name = 'country') > 0 THEN max(v.value) FILTER (WHERE v.name = 'country') ELSE 'none' END AS country, max(v.value) FILTER (WHERE v.name = 'issn_l') AS issn_l FROM topics t LEFT JOIN v USING (topic_id) GROUP BY t.topic_id, t.title",
        "sitemap_listed": f"SELECT topic_id, category_id FROM {listed} ORDER BY topic_id LIMIT 100",
        "sitemap_news": f"SELECT topic_id, bumped_at FROM {listed} AND bumped_at > TIMESTAMP '{NOW}' - INTERVAL 72 HOUR ORDER BY bumped_at DESC, topic_id LIMIT 50000",
        "search_top8": "SELECT topic_id, title FROM topics WHERE contains(lower(title), 'review') ORDER BY bumped_at DESC NULLS LAST, topic_id LIMIT 8",
        "untreated_documents": "SELECT doc_id FROM documents WHERE NOT coalesce(contains(text, '<'), false)",
        "path_ids": "SELECT topic_id, CASE WHEN topic_id % 4 IN (0, 1) THEN topic_id END AS found FROM topics",
        "settings_split": "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(p_brand || ' ,' || p_name || '| , ' || p_type, '[,|]'), lambda x: trim(x)), lambda x: x <> ''), ';') AS items FROM part",
        "labels_localized": "SELECT r_regionkey, CASE WHEN r_regionkey % 4 = 0 THEN '地区 ' || r_name WHEN r_regionkey % 4 = 1 THEN 'Area ' || r_name WHEN r_regionkey % 4 = 2 THEN r_name ELSE 'r3' END AS label FROM region",
        "tri_state": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS flag FROM customer",
        "related_topics": f"WITH it AS {items}, f AS (SELECT * FROM (SELECT * FROM {tags} UNION ALL {own}) WHERE id IN (SELECT id FROM it)), sc AS (SELECT a.id, b.id AS other_id, sum(a.pts)::BIGINT AS score FROM f a JOIN f b ON a.f = b.f AND a.id <> b.id GROUP BY 1, 2) SELECT id, other_id, score, rn AS place FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.id ORDER BY score DESC, recency DESC NULLS LAST, other_id) AS rn FROM sc JOIN it ON it.id = other_id) WHERE rn <= 5",
    }


def queries() -> dict[str, Query]:
    named = (
        plan_written, sync_order, plan_from_details, page_totals, run_results, category_exists, follow_up_ids, merged_maps, sitemap_listed,
        sitemap_news, search_top8, untreated_documents, path_ids, settings_split, labels_localized, tri_state, related_topics,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return _sql()
