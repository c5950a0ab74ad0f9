"""Derivations for display and search: series, shares, charts, excerpts and structured data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions.scalars import clamp, first_digits, is_blank, iso8601, leading_number, thousands, truncated


def recent_history(rows: DataFrame, entity: str, year: str, most: int = 15) -> DataFrame:
    """The ``most`` latest years of each entity, with ``rank`` 1 for the latest."""
    w = Window.partitionBy(entity).orderBy(F.desc(year))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def latest_per_entity(rows: DataFrame, entity: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each entity's last row, as one aggregate of a struct's maximum."""
    last = F.max(F.struct(*order, *(v for v in values if v not in order))).alias("x")
    return rows.groupBy(entity).agg(last).select(entity, *(F.col(f"x.{v}").alias(v) for v in values))


def share_of_total(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add a value's percentage of the sum over all rows, 0 where the sum is 0.

    The sum is one aggregated row beside the table, not a window over all of it.
    """
    total = rows.agg(F.sum(value).alias("__total"))
    share = F.when(F.col("__total") > 0, F.round(F.col(value) / F.col("__total") * 100, 1)).otherwise(0.0)
    return rows.join(F.broadcast(total), F.lit(True)).withColumn(name, share).drop("__total")


def running_offset(by: str, value: str, order: Sequence[str]) -> Column:
    """What comes before a row: the exclusive prefix sum, 0 for the first."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def weight_1_to_5(by: str, value: str) -> Column:
    """A value against its group's greatest, on a scale of 1 to 5."""
    top = F.max(value).over(Window.partitionBy(by))
    top = F.when(top == 0, 1).otherwise(top)
    return clamp(F.ceil(F.col(value) / top * 5), 1, 5).cast("int")


def value_range(low: Column, high: Column) -> tuple[Column, Column]:
    """The range of an axis: 0 always lies in it, and it is at least 1 wide where it is empty."""
    low, high = F.least(low, F.lit(0)), F.greatest(high, F.lit(0))
    return low, F.when(high == low, low + 1).otherwise(high)


def chart_points(rows: DataFrame, series: str, order: str, value: str, width: float = 100.0, height: float = 100.0) -> DataFrame:
    """Add x and y of each point: even steps in x; y from the top of the range (0) down to its bottom.

    A series of a single point has no line and gives x = 0.
    """
    w = Window.partitionBy(series)
    lo, hi = value_range(F.min(value).over(w), F.max(value).over(w))
    rows = rows.withColumns({"__lo": lo, "__hi": hi})
    x = F.percent_rank().over(Window.partitionBy(series).orderBy(order)) * width
    y = (F.lit(1.0) - (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))) * height
    return rows.withColumns({"x": F.round(x, 4), "y": F.round(y, 4)}).drop("__lo", "__hi")


def axis_ticks(low: Column, high: Column) -> Column:
    """Five evenly spaced values over the range of an axis that shows ``low`` to ``high``."""
    low, high = value_range(low, high)
    return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: low + i / 4.0 * (high - low))


def thinned_ticks(rows: DataFrame, series: str, order: str) -> DataFrame:
    """The labels of an axis that fit: every step-th and the last, without one less than a step before it.

    The step is 1 up to 8 labels, 2 up to 15, 3 up to 25, then a seventh of them.
    """
    w = Window.partitionBy(series)
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    n, i = F.col("__n"), F.col("i")
    rows = rows.withColumn("__step", F.when(n <= 8, 1).when(n <= 15, 2).when(n <= 25, 3).otherwise(F.ceil(n / 7)).cast("int"))
    on_step = (i % F.col("__step") == 0) & (n - 1 - i >= F.col("__step"))
    return rows.where(on_step | (i == n - 1)).drop("__n", "__step")


def _plain_line() -> Column:
    jcr = F.get("jcr", F.lit(0))
    return F.concat_ws(
        " | ",
        F.col("identity.title"),
        F.concat(F.lit("ISSN-L: "), F.coalesce("identity.issn_l", F.lit(""))),
        F.concat(F.lit("Publisher: "), F.col("publication.publisher_name")),
        F.concat(F.lit("IF: "), jcr["impact_factor"], F.lit(" ("), F.coalesce(jcr["year"].cast("string"), F.lit("")), F.lit(")")),
        F.concat(F.lit("Works: "), F.col("metrics.works_count").cast("string")),
        F.concat(F.lit("Cited by: "), F.col("metrics.cited_by_count").cast("string")),
    )


def plain_text(record: DataFrame) -> DataFrame:
    """unified_id and one line of the record's main facts."""
    return record.select("unified_id", _plain_line().alias("plain_text"))


def seo_excerpt(record: DataFrame, most: int = 300) -> DataFrame:
    """unified_id and a search excerpt of at most ``most`` characters."""
    jcr, sjr = F.get("jcr", F.lit(0)), F.get("scimago", F.lit(0))
    title = F.coalesce("identity.title", F.lit("Unknown journal"))
    head = F.concat_ws(
        ", ",
        title,
        F.when(~is_blank(F.col("publication.publisher_name")), F.concat(F.lit("published by "), F.col("publication.publisher_name"))),
        F.when(~is_blank(F.col("identity.issn_l")), F.concat(F.lit("ISSN: "), F.col("identity.issn_l"))),
    )
    ranks = F.concat_ws(
        ", ",
        F.concat(F.lit("Impact factor "), jcr["impact_factor"], F.lit(" ("), jcr["year"].cast("string"), F.lit(")")),
        F.concat(F.lit("SJR "), sjr["best_quartile"]),
    )
    stats = F.concat_ws(
        ", ",
        F.concat(thousands(F.col("metrics.works_count")), F.lit(" works")),
        F.concat(thousands(F.col("metrics.cited_by_count")), F.lit(" citations")),
        F.concat(F.lit("h-index "), F.col("metrics.h_index").cast("string")),
    )
    sentences = F.concat_ws(
        ". ", head, F.nullif(ranks, F.lit("")), F.nullif(stats, F.lit("")), F.when(F.col("open_access.is_oa"), "Open access")
    )
    text = F.regexp_replace(sentences, r"^[\s\x00]+|[\s\x00]+$", "")
    text = F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))
    return record.select("unified_id", truncated(text, most, "...", mark_counts=True).alias("excerpt"))


def status_flags(record: DataFrame) -> DataFrame:
    """The flags that are known, in long form: unified_id, flag, value."""
    yes = lambda c: F.when(~is_blank(c), F.trim(c) == "是")
    oa = F.col("open_access")
    flags = {c: oa[c] for c in ("is_oa", "is_in_doaj", "diamond_oa", "has_apc", "has_waiver", "boai", "copyright_author_retains", "plagiarism_detection", "has_preservation", "has_deposit_policy")}
    flags |= {"is_core": F.col("publication.is_core"), "cas_review": yes(oa["cas_review"]), "cas_top": yes(oa["cas_top"])}
    rows = F.array(*(F.struct(F.lit(n).alias("flag"), v.alias("value")) for n, v in flags.items()))
    return record.select("unified_id", F.explode(rows).alias("x")).select("unified_id", "x.flag", "x.value").where("value is not null")


# The charts of a record in their order, the section that each is drawn from, and its fields.
CHARTS = {
    "sjr": ("scimago", ("sjr",)),
    "total_docs": ("scimago", ("total_docs_year",)),
    "cites_per_doc": ("scimago", ("citations_per_doc_2years",)),
    "female_pct": ("scimago", ("female_pct",)),
    "refs_per_doc": ("scimago", ("ref_per_doc",)),
    "policy_docs": ("scimago", ("overton",)),
    "sdg_docs": ("scimago", ("sdg",)),
    "annual_citations": ("counts", ("cited_by_count",)),
    "works_vs_oa": ("counts", ("works_count", "oa_works_count")),
    "total_citations_wide": ("counts", ("cited_by_count",)),
    "dois_by_year": ("dois", ("count",)),
    "oa_works_trend": ("counts", ("oa_works_count",)),
    "jcr_if": ("jcr", ("impact_factor",)),
}


def chart_series(record: DataFrame) -> DataFrame:
    """The thirteen yearly charts of a record in long form: unified_id, chart, field, place, year, value.

    Places count from 1 for the oldest year. A chart needs two years of its
    section or more; values that are missing or no numbers are 0, as texts
    count the number at their start. Years without an impact factor are no
    part of ``jcr_if``.
    """
    parts = record.select(
        "unified_id", "scimago", F.col("metrics.counts_by_year").alias("counts"), F.col("crossref_quality.dois_by_year").alias("dois"),
        F.filter("jcr", lambda x: x["impact_factor"].isNotNull()).alias("jcr"),
    )

    def rows(chart: str, section: str, fields: Sequence[str]) -> Column:
        one = lambda f: F.transform(
            F.reverse(section),
            lambda x, i: F.struct(
                F.lit(chart).alias("chart"), F.lit(f).alias("field"), (i + 1).alias("place"),
                x["year"].cast("bigint").alias("year"), leading_number(x[f]).alias("value"),
            ),
        )
        none = F.array().cast("array<struct<chart: string, field: string, place: int, year: bigint, value: double>>")
        return F.when(F.size(section) >= 2, F.concat(*map(one, fields))).otherwise(none)

    every = F.concat(*(rows(c, *of) for c, of in CHARTS.items()))
    return parts.select("unified_id", F.explode(every).alias("x")).select("unified_id", "x.*")


def chart_table(record: DataFrame) -> DataFrame:
    """The rows below each chart, the latest year first: unified_id, chart, field, row (from 1), year, value."""
    series = chart_series(record).groupBy("unified_id", "chart", "field", "year", "value", "place").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("unified_id", "chart", "field").orderBy(F.desc("year"), "place", "value")
    return series.select("unified_id", "chart", "field", F.row_number().over(w).alias("row"), "year", "value", "n")


def topic_cloud(record: DataFrame) -> DataFrame:
    """The topics of a record with a weight of 1 to 5 by their count: unified_id, topic, weight."""
    topics = F.col("subjects_topics.topics")
    top = F.array_max(F.transform(topics, lambda t: F.coalesce(t["count"], F.lit(0))))
    top = F.when(top > 0, top).otherwise(1)
    weight = lambda t: clamp(F.ceil(F.coalesce(t["count"], F.lit(0)) / top * 5), 1, 5).cast("int")
    rows = F.transform(topics, lambda t: F.struct(t["name"].alias("topic"), weight(t).alias("weight")))
    return record.select("unified_id", F.explode(rows).alias("x")).select("unified_id", "x.topic", "x.weight")


def topic_donut(record: DataFrame) -> DataFrame:
    """Topic shares as segments: unified_id, topic, percent and what comes before; two shares or more."""
    shares = F.col("subjects_topics.topic_shares")
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x["value"])
    before = lambda i: F.aggregate(F.slice(shares, F.lit(1), i), F.lit(0.0), lambda a, x: a + x["value"])
    percent = lambda v: F.when(total > 0, F.round(v / total * 100, 1)).otherwise(0.0)
    rows = F.transform(shares, lambda x, i: F.struct(x["name"].alias("topic"), percent(x["value"]).alias("percent"), percent(before(i)).alias("offset")))
    return record.where(F.size(shares) >= 2).select("unified_id", F.explode(rows).alias("x")).select("unified_id", "x.*")


def coverage_bars(record: DataFrame) -> DataFrame:
    """Metadata coverage in long form: unified_id, part, percent."""
    return record.where("crossref_quality.coverage is not null").select(
        "unified_id", F.explode("crossref_quality.coverage").alias("part", "percent")
    )


# Warning levels and how severe they are shown.
SEVERITY = {"高": "high", "中": "med"}


def warning_timeline(record: DataFrame) -> DataFrame:
    """Warnings by year, oldest first: unified_id, place (from 0), year, level, severity."""
    oldest = F.reverse(F.col("warning"))
    table = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    long = record.where("warning is not null").select("unified_id", F.posexplode(oldest).alias("place", "w"))
    severity = F.coalesce(F.try_element_at(table, F.col("w.level")), F.lit("low"))
    return long.select("unified_id", "place", "w.year", "w.level", severity.alias("severity"))


def json_ld(
    record: DataFrame,
    url: Column | None = None,
    description: Column | None = None,
    keywords: Column | None = None,
    created: Column | None = None,
    updated: Column | None = None,
) -> DataFrame:
    """unified_id and a schema.org Periodical as JSON, without what is unknown.

    The metrics are added to a description only where there is one.
    """
    p, i, m = F.col("publication"), F.col("identity"), F.col("metrics")
    jcr = F.get("jcr", F.lit(0))
    present = lambda c: F.when(~is_blank(c), c)
    text = lambda c: F.lit(None).cast("string") if c is None else c
    place = F.coalesce(present(p["country_name"]), present(p["country_code"]))
    numbers = F.concat_ws(
        ", ",
        F.concat(F.lit("Works: "), m["works_count"].cast("string")),
        F.concat(F.lit("Citations: "), m["cited_by_count"].cast("string")),
        F.concat(F.lit("H-Index: "), m["h_index"].cast("string")),
    )
    told = present(text(description))
    thing = lambda x: F.struct(F.lit("Thing").alias("@type"), x.alias("name"))
    subjects = F.col("subjects_topics.subjects")
    moment = lambda c: text(None) if c is None else iso8601(c)
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("Periodical").alias("@type"),
        i["title"].alias("name"),
        text(url).alias("url"),
        present(i["issn_l"]).alias("issn"),
        F.when(~is_blank(p["publisher_name"]), F.struct(F.lit("Organization").alias("@type"), p["publisher_name"].alias("name"))).alias("publisher"),
        present(i["cover_url"]).alias("image"),
        present(text(keywords)).alias("keywords"),
        F.when(place.isNotNull(), F.struct(F.lit("Country").alias("@type"), place.alias("name"))).alias("countryOfOrigin"),
        moment(created).alias("dateCreated"),
        moment(updated).alias("dateModified"),
        F.when(numbers != "", F.concat(told, F.lit(". "), numbers)).otherwise(told).alias("description"),
        present(i["abbreviation"]).alias("alternateName"),
        p["first_publication_year"].cast("string").alias("startDate"),
        F.when(F.col("open_access.is_oa"), F.lit(True)).alias("isAccessibleForFree"),
        F.concat(F.lit("Impact Factor: "), jcr["impact_factor"], F.lit(" ("), F.coalesce(jcr["year"].cast("string"), F.lit("")), F.lit(")")).alias("award"),
        F.when(F.size(subjects) > 0, F.transform(F.slice(subjects, 1, 5), thing)).alias("about"),
    )
    return record.select("unified_id", F.to_json(doc).alias("json_ld"))


def record_json(record: DataFrame) -> DataFrame:
    """unified_id and the whole canonical record as JSON, with what is unknown as null."""
    sections = [c for c in record.columns if c != "unified_id"]
    return record.select("unified_id", F.to_json(F.struct(*sections), {"ignoreNullFields": "false"}).alias("record"))


def prepared_records(record: DataFrame) -> DataFrame:
    """What is written out for a record: unified_id, title, raw_text, record, issn_l, publisher, cover_url, country.

    Records without a title are left out.
    """
    i, p = F.col("identity"), F.col("publication")
    line, whole = _plain_line(), F.to_json(F.struct(*(c for c in record.columns if c != "unified_id")), {"ignoreNullFields": "false"})
    return record.where(~is_blank(i["title"])).select(
        "unified_id", i["title"].alias("title"), line.alias("raw_text"), whole.alias("record"), i["issn_l"].alias("issn_l"),
        p["publisher_name"].alias("publisher"), i["cover_url"].alias("cover_url"), F.coalesce(p["country_name"], p["country_code"]).alias("country"),
    )


def cas_zone_text(record: DataFrame) -> DataFrame:
    """unified_id and the digits of the latest zone."""
    return record.select("unified_id", first_digits(F.get("cas_partition", F.lit(0))["major_quartile"]).alias("zone"))


def narrative(record: DataFrame) -> DataFrame:
    """unified_id and a paragraph on volume, years, access and ranks."""
    m, p, oa = F.col("metrics"), F.col("publication"), F.col("open_access")
    jcr, sjr = F.get("jcr", F.lit(0)), F.get("scimago", F.lit(0))
    volume = F.concat(
        F.lit("It has published "), thousands(m["works_count"]), F.lit(" works with "), thousands(m["cited_by_count"]), F.lit(" citations"),
        F.coalesce(F.concat(F.lit(", "), thousands(m["oa_works_count"]), F.lit(" of them open access")), F.lit("")), F.lit("."),
    )
    years = F.concat(F.lit("Years "), p["first_publication_year"].cast("string"), F.lit(" to "), p["last_publication_year"].cast("string"), F.lit("."))
    access = F.concat(
        F.when(oa["is_oa"], "It is open access").otherwise("It is not open access"),
        F.when(oa["is_in_doaj"], " and listed in DOAJ.").otherwise(" and not listed in DOAJ."),
    )
    impact = F.concat(F.lit("Impact factor "), jcr["impact_factor"], F.lit(" in "), jcr["year"].cast("string"), F.coalesce(F.concat(F.lit(", "), jcr["quartile"]), F.lit("")), F.lit("."))
    rank = F.concat(F.lit("SJR "), F.format_string("%.3f", sjr["sjr"]), F.coalesce(F.concat(F.lit(", "), sjr["best_quartile"]), F.lit("")), F.lit("."))
    rank = F.when(sjr["sjr"].isNotNull(), rank)
    cas = F.get("cas_partition", F.lit(0))
    zone = F.concat(F.lit("Zone "), first_digits(cas["major_quartile"]), F.coalesce(F.concat(F.lit(" in "), cas["major_category"]), F.lit("")), F.lit("."))
    return record.select("unified_id", F.concat_ws(" ", volume, years, access, impact, rank, zone).alias("narrative"))


def sitemap_page(topics: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of all listed topics by id."""
    return topics.orderBy("topic_id").offset((number - 1) * size).limit(size)


def sitemap_recent(topics: DataFrame, since: Column, most: int = 50_000) -> DataFrame:
    """The topics bumped after an instant, the latest first."""
    return topics.where(F.col("bumped_at") > since).orderBy(F.desc("bumped_at"), "topic_id").limit(most)


def listed(topics: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    """Visible topics that are not deleted, of categories that anyone may read.

    ``categories`` is a small dimension with the category and ``restricted``.
    """
    open_ones = categories.where("not restricted").select(category)
    return topics.where("visible and deleted_at is null").join(open_ones, category)


def search(topics: DataFrame, title: str, words: str, most: int = 8) -> DataFrame:
    """The first ``most`` topics whose titles contain the words, whatever the case, the latest bumped first."""
    hit = F.contains(F.lower(title), F.lit(words.lower()))
    return topics.where(hit).orderBy(F.desc_nulls_last("bumped_at"), "topic_id").limit(most)


def without_marker(rows: DataFrame, column: str, marker: str) -> DataFrame:
    """Rows that were not yet treated: their text has no marker; null texts count as untreated."""
    return rows.where(~F.coalesce(F.contains(F.col(column), F.lit(marker)), F.lit(False)))
