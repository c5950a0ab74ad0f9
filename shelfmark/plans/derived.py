"""Queries on canonical records: sections, tags, related items, series, text and ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import scalars as s
from shelfmark.operators import audit, cards, derive, normalize, related, tags
from shelfmark.plans import record_sql
from shelfmark.plans.matching import CATEGORY
from shelfmark.session import scratch_folder
from shelfmark.sources.tables import table
from shelfmark.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
NOW = "2024-01-31 00:00:00"  # the reference instant of queries on recent rows


def records(spark: SparkSession, d: str) -> DataFrame:
    return normalize.canonical_record(table(spark, d, "catalogue").where("unified.id is not null"))


# --- sections -------------------------------------------------------------------------


def section_identity(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select("unified_id", "identity.*")
    return r.select("unified_id", "title", "abbreviation", "issn_l", "openalex_type", "homepage_url", F.array_join("alternate_titles", "|").alias("alternates"))


def section_publication(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("unified_id", "publication.*").drop("is_core")


def section_metrics(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("unified_id", "metrics.works_count", "metrics.cited_by_count", "metrics.h_index", "metrics.i10_index")


def history_top15(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select("unified_id", F.posexplode("metrics.counts_by_year").alias("rank", "y"))
    return r.select("unified_id", F.col("rank").cast("bigint").alias("rank"), "y.year", "y.works_count", "y.cited_by_count")


def section_open_access(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("unified_id", *(f"open_access.{c}" for c in ("is_oa", "is_in_doaj", "has_apc", "diamond_oa", "boai", "publication_time_weeks", "cas_review", "cas_oaj", "cas_top")))


def section_scimago(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select("unified_id", F.explode("scimago").alias("y"))
    return r.select("unified_id", "y.*")


def section_jcr_latest(spark: SparkSession, d: str) -> DataFrame:
    latest = F.get("jcr", F.lit(0))
    fields = ("year", "impact_factor", "quartile", "rank", "category")
    return records(spark, d).where("jcr is not null").select("unified_id", *(latest[f].alias(f) for f in fields), F.size("jcr").cast("bigint").alias("n_years"))


def section_topics(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select("unified_id", F.posexplode("subjects_topics.topics").alias("pos", "t"))
    return r.select("unified_id", F.col("pos").cast("bigint").alias("pos"), "t.name", "t.count", "t.field")


def section_keywords(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.select("unified_id", F.explode(F.concat("subjects_topics.keywords", "subjects_topics.subjects")).alias("word"))


def section_crossref(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).where("crossref_quality is not null")
    return r.select("unified_id", "crossref_quality.total_dois", "crossref_quality.current_dois", F.size("crossref_quality.dois_by_year").cast("bigint").alias("n_years"))


def section_presence(spark: SparkSession, d: str) -> DataFrame:
    """How many records have each of the sections that may be missing."""
    names = ("jcr", "scimago", "cas_partition", "warning", "crossref_quality", "scirev", "ccf", "wikidata_meta")
    one = records(spark, d).agg(*(F.count(n).alias(n) for n in names))
    pairs = F.array(*(F.struct(F.lit(n).alias("section"), F.col(n).alias("n_records")) for n in names))
    return one.select(F.explode(pairs).alias("x")).select("x.section", "x.n_records")


# --- tags and related items -----------------------------------------------------------


def tag_assignments(spark: SparkSession, d: str) -> DataFrame:
    return tags.tag_assignments(records(spark, d))


def tag_group_counts(spark: SparkSession, d: str) -> DataFrame:
    return tags.tag_assignments(records(spark, d)).groupBy("tag_group").agg(F.count(F.lit(1)).alias("n_tags"), F.count_distinct("unified_id").alias("n_records"))


def tag_memberships_missing(spark: SparkSession, d: str) -> DataFrame:
    """The memberships that are missing if the tags of the records with even ids are there."""
    assigned = tags.tag_assignments(records(spark, d))
    members = assigned.where("unified_id % 2 = 0").select("tag_group", "tag").distinct()
    return tags.ensure_memberships(members, assigned)


def tag_lists(spark: SparkSession, d: str) -> DataFrame:
    """All tags of each record in one text."""
    t = tags.tag_assignments(records(spark, d))
    return t.groupBy("unified_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))


def tags_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The tags after the records with odd ids were tagged anew; stored are those of all records under other names."""
    t = tags.tag_assignments(records(spark, d)).select("unified_id", "tag")
    current = t.select("unified_id", F.concat(F.lit("old-"), "tag").alias("tag")).distinct()
    return tags.replace_tags(current, t.where("unified_id % 2 = 1"), "unified_id")


def retired_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tag groups without those of earlier versions: the present ones and the retired ones are stored."""
    names = [*tags.TAG_GROUPS.values(), *tags.RETIRED_GROUPS]
    stored = table(spark, d, "part").select(F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int")).alias("name"))
    return tags.without_retired(stored).groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


def contains_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first of the listed publishers that each name in the publisher fields contains."""
    c = table(spark, d, "catalogue")
    names = c.select("page", "pos", F.explode(F.array("unified.crossref_publisher", "unified.doaj_publisher", "sources.openalex.main.host_organization_name")).alias("name"))
    return names.select("page", "pos", "name", s.contains_first(F.col("name"), tags.MAJOR_PUBLISHERS).alias("found")).where("name is not null")


def _part_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("publisher"), F.col("p_type").alias("country"), F.col("p_retailprice").alias("recency"))
    labels = p.select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(F.array(F.concat(F.lit("size"), F.col("p_size").cast("string")), F.concat(F.lit("name "), F.col("p_name"))))).alias("tag"))
    return items, labels


def related_topk_one(spark: SparkSession, d: str) -> DataFrame:
    items, labels = _part_items(spark, d)
    return related.related_to_one(items, labels, 1, k=5, criteria=("tags", "publisher", "country"))


def related_topk_all(spark: SparkSession, d: str) -> DataFrame:
    items, labels = _part_items(spark, d)
    features = labels.select("id", F.concat(F.lit("t:"), "tag").alias("feature"), F.lit(3).alias("points")).unionByName(
        items.select("id", F.concat(F.lit("p:"), "publisher").alias("feature"), F.lit(2).alias("points"))
    )
    return related.related_to_all(items, features, k=5).select("id", "other_id", F.col("score").cast("bigint").alias("score"))


def related_in_order(spark: SparkSession, d: str) -> DataFrame:
    return related.in_order(table(spark, d, "part"), [5, 3, 9, 1], "p_partkey").select("p_partkey", "p_name")


# --- windows and series ---------------------------------------------------------------


def latest_per_entity(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return derive.latest_per_entity(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_totalprice"])


def unpivot_slots(spark: SparkSession, d: str) -> DataFrame:
    """Numbered columns to rows, blank ones dropped, their order kept."""
    p = table(spark, d, "part").withColumn("words", F.split("p_name", " "))
    wide = p.select("p_partkey", *(F.get("words", F.lit(i)).alias(f"word_{i + 1}") for i in range(6)))
    slots = F.array(*(F.struct(F.lit(i).alias("slot"), F.col(f"word_{i}").alias("word")) for i in range(1, 7)))
    return wide.select("p_partkey", F.explode(F.filter(slots, lambda x: ~s.is_blank(x["word"]))).alias("x")).select("p_partkey", F.col("x.slot").alias("slot"), "x.word")


def find_first(spark: SparkSession, d: str) -> DataFrame:
    """Each catalogue row's first topic in the life sciences."""
    c = table(spark, d, "catalogue").where("unified.id is not null")
    first = F.get(F.filter("sources.openalex.topics", lambda t: t["domain_display_name"] == "Life Sciences"), F.lit(0))
    return c.select("page", "pos", first["display_name"].alias("topic")).where("topic is not null")


def distinct_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Alternate titles with the name itself, each once, the first five."""
    c = table(spark, d, "catalogue").where("unified.id is not null")
    every = F.concat(F.array("unified.canonical_name"), F.coalesce(F.transform("sources.openalex.alternate_titles", lambda x: x["title"]), F.array().cast("array<string>")))
    return c.select("page", "pos", F.array_join(F.slice(F.array_distinct(F.array_compact(every)), 1, 5), "|").alias("names"))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def topic_json(spark: SparkSession, d: str) -> DataFrame:
    """The stored record of a topic, parsed with a declared schema."""
    f = table(spark, d, "topic_custom_fields").where("name = 'data'")
    shape = "identity struct<issn_l: string>, publication struct<publisher_name: string, country_code: string>, metrics struct<h_index: bigint>"
    return f.select("id", F.from_json("value", shape).alias("r")).select("id", F.col("r.identity.issn_l").alias("issn_l"), F.col("r.publication.publisher_name").alias("publisher"), F.col("r.metrics.h_index").alias("h_index"))


def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").groupBy("p_type").agg(F.sum("p_size").cast("bigint").alias("total_size"))
    return derive.share_of_total(t, "total_size", "share")


def running_offset(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.sum("p_size").cast("bigint").alias("total_size"))
    return t.withColumn("offset", derive.running_offset("p_type", "total_size", ["p_brand"]))


def weight_1_5(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("weight", derive.weight_1_to_5("p_type", "n"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Series of 2 to 41 points by customer group: positive, negative, mixed and all-zero ones."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("series"), F.col("o_orderkey"), "o_totalprice")
    step = o.select("series", (F.col("o_orderkey") % (F.col("series") + 2)).alias("step"), F.floor("o_totalprice").cast("bigint").alias("n"))
    n = F.sum("n")
    sign = F.when(F.col("series") % 4 == 0, n).when(F.col("series") % 4 == 1, -n).when(F.col("series") % 4 == 2, n % 2001 - 1000).otherwise(n * 0)
    return step.groupBy("series", "step").agg(sign.cast("bigint").alias("n"))


def chart_points(spark: SparkSession, d: str) -> DataFrame:
    return derive.chart_points(_series(spark, d), "series", "step", "n")


def tick_thinning(spark: SparkSession, d: str) -> DataFrame:
    return derive.thinned_ticks(_series(spark, d), "series", "step").select("series", "step", F.col("i").cast("bigint").alias("i"))


def axis_ticks(spark: SparkSession, d: str) -> DataFrame:
    t = _series(spark, d).groupBy("series").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return t.select("series", F.posexplode(derive.axis_ticks(F.col("lo"), F.col("hi"))).alias("i", "tick"))


def recent_window_topn(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where(F.col("ts") > F.expr(f"timestamp_ntz'{NOW}' - interval 3 days")).orderBy(F.desc("ts"), "event_id").limit(1000).select("event_id", "ts")


def sitemap_page(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics").where((F.col("category_id") == CATEGORY) & F.col("visible") & F.col("deleted_at").isNull())
    return derive.sitemap_page(t, 2, 100).select("topic_id", "updated_at")


def sitemap_recent(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics").where("visible and deleted_at is null")
    return derive.sitemap_recent(t, F.expr("timestamp_ntz'2025-06-01 00:00:00'"), 500).select("topic_id", "bumped_at")


def latest_bump(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topics").groupBy("category_id").agg(F.max("bumped_at").alias("last_bump"))


# --- text -----------------------------------------------------------------------------


def scalar_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Decimals with commas, leading integers and coalesced values of customers' balances."""
    c = table(spark, d, "customer")
    text = F.concat(F.replace(F.format_string("%.2f", "c_acctbal"), F.lit("."), F.lit(",")), F.lit(" EUR"))
    return c.select(
        "c_custkey",
        s.decimal_comma(text).alias("amount"),
        s.leading_int(text).alias("whole"),
        s.first_present(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.col("c_name")).alias("label"),
    )


def bool_first_truthy(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "catalogue")
    b = s.first_truthy(F.col("unified.openalex_is_oa"), F.col("sources.openalex.main.is_oa"))
    return c.groupBy(F.col("unified.openalex_is_oa").alias("a"), F.col("sources.openalex.main.is_oa").alias("b"), b.alias("result")).agg(F.count(F.lit(1)).alias("n"))


def thousands_fmt(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "catalogue").where("unified.openalex_cited_by_count is not null")
    return c.select("page", "pos", s.thousands(F.col("unified.openalex_cited_by_count")).alias("text"))


def axis_label(spark: SparkSession, d: str) -> DataFrame:
    """Values of every band, whole and broken, of both signs."""
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    value = (
        F.when(k % 6 == 0, price * 1000 + 7).when(k % 6 == 1, price).when(k % 6 == 2, price % 1000)
        .when(k % 6 == 3, (k % 4000) / 4.0).when(k % 6 == 4, -(price % 20000)).otherwise(price % 100000)
    )
    return table(spark, d, "orders").select("o_orderkey", s.axis_label(value).alias("label"))


def eta_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", s.eta_text(F.col("event_id") % 9000).alias("eta"))


def initials(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    title = F.concat_ws(" of the ", F.col("c_mktsegment"), F.regexp_replace("c_name", "#", "-x"))
    return c.select("c_custkey", s.initials(title).alias("initials"))


def url_strip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "catalogue").where("sources.openalex.main.homepage_url is not null")
    return c.select("page", "pos", s.bare_url(F.col("sources.openalex.main.homepage_url")).alias("shown"))


# Templates with unknown keys, keys in a row, separators left dangling, and what is no key.
TEMPLATES = (
    "{{name}}, {{nothing}}, {{segment}} - {{nothing}} - end",
    " - {{segment}}  ;  {{name}} ,",
    "{{nothing}}-{{segment}}\n{{name}}, ,\n",
    "{{ name }} {{{segment}}} {{name}}{{name}}",
)


def template_fill(spark: SparkSession, d: str) -> DataFrame:
    """Templates over customers; some values are null and some look like keys."""
    k = F.col("c_custkey")
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), (k % 4 + 1).cast("int"))
    values = {
        "name": F.when(k % 3 != 0, F.col("c_name")),
        "segment": F.when(k % 5 == 0, F.lit("{{name}}")).otherwise(F.col("c_mktsegment")),
    }
    return table(spark, d, "customer").select("c_custkey", s.fill_template(template, values).alias("text"))


def digest_features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    f = s.digest_features(F.col("p_name"), 12, 40)
    return p.select("p_partkey", F.sha1("p_name").alias("sha1"), F.md5("p_name").alias("md5"), f["palette"].alias("palette"), f["icon"].alias("icon"), f["grid"].alias("grid"))


def cover_changed(spark: SparkSession, d: str) -> DataFrame:
    """Topics whose stored cover hash is not that of the full cover URL."""
    from shelfmark.operators.attributes import pivoted

    wide = pivoted(table(spark, d, "topic_custom_fields"), "topic_id", ("cover_url", "cover_url_hash"))
    full = s.absolute_url(F.col("cover_url"), "https://covers.example")
    return wide.where(F.col("cover_url").isNotNull() & ~F.sha1(full).eqNullSafe(F.col("cover_url_hash"))).select("topic_id", F.sha1(full).alias("new_hash"))


def excerpt(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", s.truncated(s.escape_html(F.col("text")), 45).alias("short"))


def record_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return derive.seo_excerpt(records(spark, d))


def record_text(spark: SparkSession, d: str) -> DataFrame:
    return derive.plain_text(records(spark, d))


def record_narrative(spark: SparkSession, d: str) -> DataFrame:
    return derive.narrative(records(spark, d))


def record_flags(spark: SparkSession, d: str) -> DataFrame:
    return derive.status_flags(records(spark, d))


def record_charts(spark: SparkSession, d: str) -> DataFrame:
    return derive.chart_series(records(spark, d))


def record_chart_table(spark: SparkSession, d: str) -> DataFrame:
    return derive.chart_table(records(spark, d))


def record_topic_cloud(spark: SparkSession, d: str) -> DataFrame:
    return derive.topic_cloud(records(spark, d))


def record_warnings(spark: SparkSession, d: str) -> DataFrame:
    return derive.warning_timeline(records(spark, d))


def leaf_audit(spark: SparkSession, d: str) -> DataFrame:
    """How many rows fill each leaf of the catalogue."""
    return audit.filled_leaves(table(spark, d, "catalogue"), ("page", "pos", "fetched_at"))


def progress_text(spark: SparkSession, d: str) -> DataFrame:
    """Progress and time left of runs made up from events."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 997).alias("done"), F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("match")), (F.col("event_id") % 3 + 1).cast("int")).alias("phase"))
    return e.select("event_id", audit.progress_percent(F.col("phase"), F.col("done"), F.lit(997)).alias("percent"), s.eta_text(audit.eta_seconds(F.lit(60), F.col("done"), F.lit(997))).alias("eta"))


def tag_highlights(spark: SparkSession, d: str) -> DataFrame:
    """The tags of each record that related items would show."""
    t = tags.tag_assignments(records(spark, d)).distinct()
    lists = t.groupBy("unified_id").agg(F.array_sort(F.collect_set("tag")).alias("names"))
    return lists.select("unified_id", F.array_join(tags.highlighted(F.col("names")), "|").alias("shown")).where("shown <> ''")


LD_FIELDS = (
    "name", "url", "issn", "publisher.name", "image", "keywords", "countryOfOrigin.name", "dateCreated", "dateModified",
    "description", "alternateName", "startDate", "isAccessibleForFree", "award",
)


def jsonld(spark: SparkSession, d: str) -> DataFrame:
    """The structured data of each record, field by field, as its JSON gives them back."""
    described = F.when(F.col("unified_id") % 2 == 0, F.concat(F.lit("About "), F.col("identity.title")))
    ld = derive.json_ld(records(spark, d), url=F.concat(F.lit("https://journals.example/t/"), F.col("unified_id")), description=described)
    names = F.from_json(F.get_json_object("json_ld", "$.about"), "array<struct<name: string, `@type`: string>>")
    about = F.array_join(F.transform(names, lambda x: F.concat(x["@type"], F.lit(":"), x["name"])), "|")
    return ld.select("unified_id", *(F.get_json_object("json_ld", f"$.{f}").alias(f.split(".")[0]) for f in LD_FIELDS), about.alias("about"))


def record_json(spark: SparkSession, d: str) -> DataFrame:
    """The stored form of each record, read back."""
    j = derive.record_json(records(spark, d))
    get = lambda p: F.get_json_object("record", f"$.{p}")
    return j.select(
        "unified_id", get("identity.title").alias("title"), get("publication.publisher_name").alias("publisher"),
        get("metrics.h_index").try_cast("bigint").alias("h_index"), get("jcr[0].impact_factor").alias("impact_factor"),
        get("subjects_topics.topics[0].name").alias("topic"), F.contains("record", F.lit('"scirev":')).alias("keeps_nulls"),
    )


def prepared_records(spark: SparkSession, d: str) -> DataFrame:
    return derive.prepared_records(records(spark, d)).drop("record")


def record_cards(spark: SparkSession, d: str) -> DataFrame:
    return cards.info_cards(records(spark, d))


def record_metric_cards(spark: SparkSession, d: str) -> DataFrame:
    return cards.metric_cards(records(spark, d))


def record_hero(spark: SparkSession, d: str) -> DataFrame:
    return cards.hero(records(spark, d)).drop("initials")


def record_indexing(spark: SparkSession, d: str) -> DataFrame:
    return cards.indexing_panel(records(spark, d))


def record_stars(spark: SparkSession, d: str) -> DataFrame:
    """How full the stars and the bar of each rated record are."""
    r = records(spark, d).select("unified_id", F.col("scirev.overall_rating").cast("double").alias("rating")).where("rating is not null")
    return r.select("unified_id", F.array_join(cards.stars(F.col("rating")), "/").alias("stars"), cards.bar_width(F.col("rating") * 20).alias("width"))


def topic_donut(spark: SparkSession, d: str) -> DataFrame:
    """The shares of each record's topics by their counts."""
    share = lambda t: F.struct(t["name"].alias("name"), F.coalesce(t["count"], F.lit(0)).cast("double").alias("value"))
    r = records(spark, d).select("unified_id", F.struct(F.transform("subjects_topics.topics", share).alias("topic_shares")).alias("subjects_topics"))
    return derive.topic_donut(r)


def coverage_bars(spark: SparkSession, d: str) -> DataFrame:
    """The scores of each record's first topics as whole per cents, the positive ones."""
    names = ("abstracts", "references", "orcids", "funders", "licenses", "affiliations")
    scores = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.get("subjects_topics.topics", F.lit(i))["score"] for i in range(len(names)))))
    r = records(spark, d).select("unified_id", F.struct(normalize.whole_percents(scores).alias("coverage")).alias("crossref_quality"))
    return derive.coverage_bars(r)


# --- ingest ---------------------------------------------------------------------------


def _stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A stream of a table's files, which lie in a folder of their own or beside other tables."""
    path = f"{d.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return incremental.file_stream(spark, path, schema)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 4).parquet(d)


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first event of every user and type, through a stream with remembered keys."""
    stream = _stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = incremental.first_seen(stream, ["user_id", "event_type"], "ts", "3650 days")
    base = scratch_folder(spark, "stream-dedupe")
    query = first.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type")


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every user, merged batch by batch."""
    stream = _stream_of(spark, d, "events").select("user_id", "event_id", "ts", "value")
    base = scratch_folder(spark, "stream-upsert")
    batches: list[int] = []
    sink = incremental.upsert_sink(spark, f"{base}/table", "user_id", "event_id")

    def counted(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        batches.append(number)

    incremental.run_to_end(stream, counted, f"{base}/log")
    return spark.read.parquet(f"{base}/table/v{max(batches)}").select("user_id", "event_id", "ts", "value")


# --- SQL side -------------------------------------------------------------------------

U = "unified"
CAT = "catalogue WHERE unified.id IS NOT NULL"
FILL_BLANK = r"'^[\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]*$'"


SERIES = (
    "(SELECT series, step, (CASE series % 4 WHEN 0 THEN n WHEN 1 THEN -n WHEN 2 THEN n % 2001 - 1000 ELSE 0 END)::BIGINT AS n FROM"
    " (SELECT o_custkey % 40 AS series, o_orderkey % (o_custkey % 40 + 2) AS step, sum(floor(o_totalprice)::BIGINT)::BIGINT AS n FROM orders GROUP BY 1, 2))"
)
RANGED = (
    f"(SELECT *, CASE WHEN hi0 = lo THEN lo + 1 ELSE hi0 END AS hi FROM (SELECT *, least(min(n) OVER (PARTITION BY series), 0) AS lo,"
    f" greatest(max(n) OVER (PARTITION BY series), 0) AS hi0 FROM {SERIES}))"
)
TYPE_BRAND = "SELECT p_type, p_brand, sum(p_size)::BIGINT AS total_size, count(*) AS n FROM part GROUP BY 1, 2"
FEATURES = (
    "(SELECT DISTINCT p_partkey AS id, 't:size' || p_size AS f, 3 AS pts FROM part UNION ALL SELECT p_partkey, 't:name ' || p_name, 3 FROM part"
    " UNION ALL SELECT p_partkey, 'p:' || p_brand, 2 FROM part)"
)


AXIS = (
    "CASE WHEN abs(v) >= 1000000 THEN printf('%.1f', round(v / 1000000.0::DOUBLE, 1)) || 'M' WHEN abs(v) >= 10000 THEN round(v / 1000.0::DOUBLE)::BIGINT || 'K'"
    " WHEN abs(v) >= 1000 THEN printf('%.1f', round(v / 1000.0::DOUBLE, 1)) || 'K' WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE printf('%.1f', v) END"
)
AXIS_VALUES = (
    "CASE o_orderkey % 6 WHEN 0 THEN p * 1000 + 7 WHEN 1 THEN p WHEN 2 THEN p % 1000 WHEN 3 THEN (o_orderkey % 4000) / 4.0::DOUBLE"
    " WHEN 4 THEN -(p % 20000) ELSE p % 100000 END"
)
# Unknown keys go first, and the segments come last, as they may look like keys.
FILLED = (
    "replace(replace(replace(t, '{{nothing}}', ''), '{{name}}', CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE '' END), '{{segment}}', CASE WHEN c_custkey % 5 = 0 THEN '{{name}}' ELSE c_mktsegment END)"
)
_TEMPLATE_LIST = ", ".join("'" + t.replace("\n", "' || chr(10) || '") + "'" for t in TEMPLATES)
TEMPLATE_SQL = (
    f"SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace({FILLED}, ',\\s*,', ',', 'g'), '\\s*-\\s*-', ' -', 'g'),"
    f" '(?m)^[,\\s-]+|[,\\s-]+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT c_custkey, c_name, c_mktsegment, [{_TEMPLATE_LIST}][c_custkey % 4 + 1] AS t FROM customer)"
)
GRID = (
    "array_to_string([" + ", ".join("||".join(f"((b >> {3 * r + min(c, 4 - c)}) & 1)::VARCHAR" for c in range(5)) for r in range(5)) + "], '/')"
)


def oracle_sql() -> dict[str, str]:
    dec = "try_cast(nullif(regexp_extract(replace(t, ',', '.'), '^\\s*([+-]?\\d+(\\.\\d+)?([eE][+-]?\\d+)?)', 1), '') AS DOUBLE)"
    return record_sql.oracle_sql() | {
        "section_identity": f"SELECT unified.id AS unified_id, unified.canonical_name AS title, coalesce(sources.wikidata.main.iso4_abbreviation, sources.openalex.alternate_titles[1].title) AS abbreviation, unified.issn_l AS issn_l, coalesce(unified.openalex_type, sources.openalex.main.type) AS openalex_type, coalesce(sources.openalex.main.homepage_url, sources.wikidata.websites[1].url) AS homepage_url, coalesce(array_to_string(list_distinct_first[1:5], '|'), '') AS alternates FROM (SELECT *, list_transform(list_filter(list_transform(coalesce(sources.openalex.alternate_titles, []), lambda x, i: {{'i': i, 't': x.title}}), lambda e: e.t IS NOT NULL AND list_position(list_transform(sources.openalex.alternate_titles, lambda z: z.title), e.t) = e.i), lambda e: e.t) AS list_distinct_first FROM {CAT})",
        "section_publication": f"SELECT unified.id AS unified_id, coalesce(unified.crossref_publisher, unified.doaj_publisher, sources.openalex.main.host_organization_name) AS publisher_name, sources.openalex.main.host_organization AS publisher_id, coalesce(unified.openalex_country, unified.doaj_country, sources.openalex.main.country_code) AS country_code, coalesce(unified.wikidata_country, unified.scimago_country, sources.wikidata.main.country_label) AS country_name, sources.openalex.main.first_publication_year AS first_publication_year, sources.openalex.main.last_publication_year AS last_publication_year FROM {CAT}",
        "section_metrics": f"SELECT unified.id AS unified_id, coalesce(unified.openalex_works_count, sources.openalex.main.works_count) AS works_count, coalesce(unified.openalex_cited_by_count, sources.openalex.main.cited_by_count) AS cited_by_count, unified.openalex_h_index::BIGINT AS h_index, unified.openalex_i10_index::BIGINT AS i10_index FROM {CAT}",
        "section_topics": f"SELECT unified_id, rn - 1 AS pos, name, count, field FROM (SELECT unified_id, t.display_name AS name, t.count AS count, t.field_display_name AS field, row_number() OVER (PARTITION BY page, pos, k ORDER BY i) AS rn FROM (SELECT page, pos, row_number() OVER () AS k, unified.id AS unified_id, unnest(sources.openalex.topics) AS t, generate_subscripts(sources.openalex.topics, 1) AS i FROM (SELECT * FROM {CAT})) WHERE t.display_name IS NOT NULL) WHERE rn <= 8",
        "section_keywords": f"SELECT unified_id, word FROM (SELECT unified.id AS unified_id, unnest(sources.doaj.keywords).keyword AS word FROM {CAT} UNION ALL SELECT unified_id, coalesce(x.term, x.code) FROM (SELECT unified.id AS unified_id, unnest(sources.doaj.subjects) AS x FROM {CAT})) WHERE word IS NOT NULL",
        "section_crossref": f"SELECT unified.id AS unified_id, sources.crossref.main.counts_total_dois AS total_dois, sources.crossref.main.counts_current_dois AS current_dois, least(15, len(list_filter(coalesce(sources.crossref.dois_by_year, []), lambda x: x.year IS NOT NULL AND x.count IS NOT NULL)))::BIGINT AS n_years FROM {CAT} AND sources.crossref IS NOT NULL",
        "related_topk_one": "WITH o AS (SELECT DISTINCT t FROM (SELECT 'size' || p_size AS t FROM part WHERE p_partkey = 1 UNION ALL SELECT 'name ' || p_name FROM part WHERE p_partkey = 1)), s AS (SELECT p.p_partkey AS other_id, 3 * ((('size' || p.p_size) IN (SELECT t FROM o))::INT + (('name ' || p.p_name) IN (SELECT t FROM o))::INT) + 2 * (p.p_brand = m.p_brand)::INT + (p.p_type = m.p_type)::INT AS score, p.p_retailprice AS recency FROM part p, (SELECT * FROM part WHERE p_partkey = 1) m WHERE p.p_partkey <> 1) SELECT other_id, score::BIGINT AS score FROM s WHERE score > 0 ORDER BY score DESC, recency DESC, other_id LIMIT 5",
        "related_topk_all": f"WITH f AS {FEATURES}, s AS (SELECT a.id, b.id AS other_id, sum(a.pts)::BIGINT AS score FROM f a JOIN f b ON a.f = b.f AND a.id <> b.id GROUP BY 1, 2) SELECT id, other_id, score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY score DESC, p_retailprice DESC, other_id) AS rn FROM s JOIN part ON p_partkey = other_id) WHERE rn <= 5",
        "related_in_order": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (5, 3, 9, 1)",
        "latest_per_entity": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
        "unpivot_slots": "SELECT p_partkey, i::INTEGER AS slot, word FROM (SELECT p_partkey, unnest(range(1, 7)) AS i, string_split(p_name, ' ') AS w FROM part), LATERAL (SELECT w[i] AS word) WHERE word IS NOT NULL AND trim(word) <> ''",
        "find_first": f"SELECT page, pos, topic FROM (SELECT page, pos, list_filter(sources.openalex.topics, lambda t: t.domain_display_name = 'Life Sciences')[1].display_name AS topic FROM {CAT}) WHERE topic IS NOT NULL",
        "distinct_keep_first": f"SELECT page, pos, array_to_string(list_transform(list_filter(list_transform(a, lambda x, i: {{'x': x, 'i': i}}), lambda e: list_position(a, e.x) = e.i)[1:5], lambda e: e.x), '|') AS names FROM (SELECT page, pos, list_filter(list_concat([unified.canonical_name], coalesce(list_transform(sources.openalex.alternate_titles, lambda t: t.title), [])), lambda x: x IS NOT NULL) AS a FROM {CAT})",
        "json_extract": "SELECT try_cast(props->>'$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
        "topic_json": "SELECT id, CASE WHEN v THEN value->>'$.identity.issn_l' END AS issn_l, CASE WHEN v THEN value->>'$.publication.publisher_name' END AS publisher, CASE WHEN v THEN try_cast(value->>'$.metrics.h_index' AS BIGINT) END AS h_index FROM (SELECT id, value, json_valid(value) AS v FROM topic_custom_fields WHERE name = 'data')",
        "share_of_total": "SELECT p_type, total_size, round(total_size::DOUBLE / sum(total_size) OVER () * 100, 1) AS share FROM (SELECT p_type, sum(p_size)::BIGINT AS total_size FROM part GROUP BY 1)",
        "running_offset": f"SELECT p_type, p_brand, total_size, coalesce(sum(total_size) OVER (PARTITION BY p_type ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM ({TYPE_BRAND})",
        "weight_1_5": f"SELECT p_type, p_brand, n, least(greatest(ceil(n::DOUBLE / max(n) OVER (PARTITION BY p_type) * 5), 1), 5)::INTEGER AS weight FROM ({TYPE_BRAND})",
        "axis_label": f"SELECT o_orderkey, {AXIS} AS label FROM (SELECT o_orderkey, ({AXIS_VALUES})::DOUBLE AS v FROM (SELECT o_orderkey, floor(o_totalprice)::DOUBLE AS p FROM orders))",
        "chart_points": f"SELECT series, step, n, round(percent_rank() OVER (PARTITION BY series ORDER BY step) * 100, 4) AS x, round((1.0::DOUBLE - (n - lo)::DOUBLE / (hi - lo)::DOUBLE) * 100, 4) AS y FROM {RANGED}",
        "tick_thinning": f"SELECT series, step, i FROM (SELECT *, max(CASE WHEN i % st = 0 AND i < c - 1 THEN i END) OVER (PARTITION BY series) AS before FROM (SELECT *, CASE WHEN c <= 8 THEN 1 WHEN c <= 15 THEN 2 WHEN c <= 25 THEN 3 ELSE ceil(c / 7.0)::BIGINT END AS st FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY series) AS c FROM {SERIES}))) WHERE i = c - 1 OR (i % st = 0 AND NOT (i = before AND c - 1 - i < st))",
        "axis_ticks": f"SELECT series, i::INTEGER AS i, lo + i / 4.0::DOUBLE * (hi - lo) AS tick FROM (SELECT series, any_value(lo) AS lo, any_value(hi) AS hi, unnest(range(0, 5)) AS i FROM {RANGED} GROUP BY 1)",
        "template_fill": TEMPLATE_SQL,
        "digest_features": f"SELECT p_partkey, sha1(p_name) AS sha1, md5(p_name) AS md5, ('0x' || h[1:2])::BIGINT % 12 AS palette, (('0x' || h[3:4])::BIGINT * 256 + ('0x' || h[5:6])::BIGINT) % 40 AS icon, {GRID} AS grid FROM (SELECT *, ('0x' || h[7:10])::BIGINT AS b FROM (SELECT *, sha256(p_name) AS h FROM part))",
        "recent_window_topn": f"SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 3 DAY ORDER BY ts DESC, event_id LIMIT 1000",
        "sitemap_page": f"SELECT topic_id, updated_at FROM topics WHERE category_id = {CATEGORY} AND visible AND deleted_at IS NULL ORDER BY topic_id LIMIT 100 OFFSET 100",
        "sitemap_recent": "SELECT topic_id, bumped_at FROM topics WHERE visible AND deleted_at IS NULL AND bumped_at > TIMESTAMP '2025-06-01 00:00:00' ORDER BY bumped_at DESC, topic_id LIMIT 500",
        "latest_bump": "SELECT category_id, max(bumped_at) AS last_bump FROM topics GROUP BY 1",
        "scalar_numbers": f"SELECT c_custkey, coalesce({dec}, 0.0) AS amount, coalesce(try_cast(nullif(regexp_extract(t, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT), 0) AS whole, label FROM (SELECT c_custkey, replace(printf('%.2f', c_acctbal), '.', ',') || ' EUR' AS t, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, c_name) AS label FROM customer)",
        "bool_first_truthy": "SELECT unified.openalex_is_oa AS a, sources.openalex.main.is_oa AS b, CASE WHEN unified.openalex_is_oa THEN true ELSE sources.openalex.main.is_oa END AS result, count(*) AS n FROM catalogue GROUP BY 1, 2, 3",
        "thousands_fmt": "SELECT page, pos, format('{:,}', unified.openalex_cited_by_count) AS text FROM catalogue WHERE unified.openalex_cited_by_count IS NOT NULL",
        "eta_text": "SELECT event_id, CASE WHEN s <= 0 THEN '' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN (s % 60) || 's' ELSE '' END ELSE (s // 3600) || 'h' || CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'm' ELSE '' END END AS eta FROM (SELECT event_id, event_id % 9000 AS s FROM events)",
        "initials": "SELECT c_custkey, array_to_string(list_transform(list_filter(string_split_regex(t, '[\\s\\-/]+'), lambda w: regexp_matches(w, '^[A-Za-z]') AND lower(w) NOT IN ('of', 'the', 'and', 'in', 'for', 'on', 'a', 'an', 'to', 'with'))[1:6], lambda w: upper(w[1])), '') AS initials FROM (SELECT c_custkey, c_mktsegment || ' of the ' || replace(c_name, '#', '-x') AS t FROM customer)",
        "url_strip": "SELECT page, pos, regexp_replace(regexp_replace(sources.openalex.main.homepage_url, '^https?://', ''), '/$', '') AS shown FROM catalogue WHERE sources.openalex.main.homepage_url IS NOT NULL",
        "cover_changed": "WITH v AS (SELECT topic_id, max(CASE WHEN name = 'cover_url' THEN value END) AS u, max(CASE WHEN name = 'cover_url_hash' THEN value END) AS h FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, name ORDER BY id DESC) AS rn FROM topic_custom_fields) WHERE rn = 1 GROUP BY 1) SELECT topic_id, sha1(f) AS new_hash FROM (SELECT topic_id, h, CASE WHEN starts_with(u, 'http') THEN u ELSE 'https://covers.example' || u END AS f FROM v WHERE u IS NOT NULL) WHERE sha1(f) IS DISTINCT FROM h",
        "excerpt": "SELECT doc_id, CASE WHEN length(t) > 45 THEN left(t, 45) || '…' ELSE t END AS short FROM (SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS t FROM documents WHERE text IS NOT NULL)",
        "record_topic_cloud": f"SELECT unified_id, t.display_name AS topic, least(greatest(ceil(coalesce(t.count, 0)::DOUBLE / CASE WHEN top > 0 THEN top ELSE 1 END * 5), 1), 5)::INTEGER AS weight FROM (SELECT unified_id, unnest(ts) AS t, list_max(list_transform(ts, lambda x: coalesce(x.count, 0))) AS top FROM (SELECT unified.id AS unified_id, list_filter(sources.openalex.topics, lambda x: x.display_name IS NOT NULL)[1:8] AS ts FROM {CAT}))",
        "topic_donut": f"WITH {record_sql.RECORDS}, t AS (SELECT uid, topics, list_sum(list_transform(topics, lambda x: coalesce(x.count, 0)::DOUBLE)) AS total FROM r WHERE len(topics) >= 2), u AS (SELECT *, unnest(topics) AS x, generate_subscripts(topics, 1) AS i FROM t) SELECT uid AS unified_id, x.display_name AS topic, CASE WHEN total > 0 THEN round(coalesce(x.count, 0)::DOUBLE / total * 100, 1) ELSE 0.0 END AS percent, CASE WHEN total > 0 THEN round(coalesce(list_sum(list_transform(topics[1:i - 1], lambda y: coalesce(y.count, 0)::DOUBLE)), 0.0::DOUBLE) / total * 100, 1) ELSE 0.0 END AS \"offset\" FROM u",
        "coverage_bars": f"WITH {record_sql.RECORDS}, u AS (SELECT uid, unnest(topics[1:6]) AS x, generate_subscripts(topics[1:6], 1) AS i FROM r) SELECT uid AS unified_id, ['abstracts', 'references', 'orcids', 'funders', 'licenses', 'affiliations'][i] AS part, round(x.score * 100)::INTEGER AS percent FROM u WHERE x.score > 0",
        "progress_text": "SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN done / 997.0::DOUBLE * 20 WHEN 1 THEN 20 + done / 997.0::DOUBLE * 70 ELSE 90 + done / 997.0::DOUBLE * 10 END, 1) AS percent, CASE WHEN s IS NULL OR s <= 0 THEN '' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN (s % 60) || 's' ELSE '' END ELSE (s // 3600) || 'h' || CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'm' ELSE '' END END AS eta FROM (SELECT event_id, event_id % 997 AS done, CASE WHEN event_id % 997 > 0 THEN ceil((997 - event_id % 997) * 60 / (event_id % 997)::DOUBLE)::BIGINT END AS s FROM events)",
        "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
        "stream_upsert": "SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
    }


def queries() -> dict[str, Query]:
    named = (
        section_identity, section_publication, section_metrics, history_top15, section_open_access, section_scimago,
        section_jcr_latest, section_topics, section_keywords, section_crossref, section_presence, tag_assignments,
        tag_group_counts, tag_memberships_missing, tag_lists, tags_replaced, retired_groups, contains_first_match, related_topk_one, related_topk_all, related_in_order,
        latest_per_entity, unpivot_slots, find_first, distinct_keep_first, json_extract, topic_json, share_of_total,
        running_offset, weight_1_5, chart_points, tick_thinning, axis_ticks, recent_window_topn, sitemap_page, sitemap_recent,
        latest_bump, scalar_numbers, bool_first_truthy, thousands_fmt, axis_label, eta_text, initials, url_strip,
        template_fill, digest_features, cover_changed, excerpt, record_excerpt, record_text, record_narrative, record_flags,
        record_charts, record_chart_table, record_topic_cloud, record_warnings, record_cards, record_metric_cards, record_hero, record_indexing, record_stars, topic_donut, coverage_bars, leaf_audit, progress_text, tag_highlights, jsonld, record_json, prepared_records, stream_dedupe, stream_upsert,
    )
    return {f.__name__: f for f in named}


