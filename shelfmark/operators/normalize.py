"""Eleven-source catalogue rows to the canonical record of fourteen sections.

Works on whatever of the declared payload a table's schema has: a field that
is not there reads as null, so the same code serves narrow and wide extracts.
Where an extract names a yearly or ranking field shortly (value, quartile,
level, rank), that field stands in for the long name.
Sections that have nothing to say are null as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.scalars import decimal_comma, first_truthy, is_blank, leading_int, tri_state

RECENT_YEARS = 15
TOPICS = 8
ALTERNATE_TITLES = 5
SUBCATEGORIES = 6


class Payload:
    """Null-propagating access to nested fields that may be absent from the schema."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def type_of(self, path: str) -> T.DataType | None:
        at: T.DataType = self.schema
        for part in path.split("."):
            if isinstance(at, T.ArrayType):
                at = at.elementType
            if not isinstance(at, T.StructType) or part not in at.names:
                return None
            at = at[part].dataType
        return at

    def get(self, path: str, kind: str = "string") -> Column:
        """The field, or a null of type ``kind`` where the schema lacks it."""
        return F.col(path) if self.type_of(path) is not None else F.lit(None).cast(kind)

    def items(self, path: str, fields: dict[str, str]) -> Column:
        """An array of structs with just ``fields`` (name to type), never null."""
        shape = ", ".join(f"{n}: {t}" for n, t in fields.items())
        none = F.array().cast(f"array<struct<{shape}>>")
        kind = self.type_of(path)
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
            return none
        there = kind.elementType.names

        def pick(x: Column) -> Column:
            return F.struct(
                *(
                    (x.getField(n).cast(t) if n in there else F.lit(None).cast(t)).alias(n)
                    for n, t in fields.items()
                )
            )

        return F.coalesce(F.transform(F.filter(F.col(path), lambda x: x.isNotNull()), pick), none)

    def one(self, path: str, fields: dict[str, str]) -> Column:
        """A struct with just ``fields``."""
        return F.struct(*(self.get(f"{path}.{n}", t).cast(t).alias(n) for n, t in fields.items()))


def latest_first(items: Column, year: Callable[[Column], Column]) -> Column:
    """Items with a year, the newest first; equal years keep their order."""
    kept = F.filter(items, lambda x: year(x).isNotNull())
    placed = F.transform(kept, lambda x, i: F.struct((-year(x)).alias("y"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p.getField("x"))


def history(p: Payload, source: str, fields: dict[str, str]) -> tuple[Column, Column]:
    """A source's yearly rows, or its current row where there are none; and whether it has any."""
    years = p.items(f"sources.{source}.all_years", fields)
    has_main = p.get(f"sources.{source}.main", "string").isNotNull()
    rows = F.when(F.size(years) > 0, years).otherwise(F.array(p.one(f"sources.{source}.main", fields)))
    return latest_first(rows, lambda x: leading_or_null(x.getField("year"))), has_main | (F.size(years) > 0)


def leading_or_null(text: Column) -> Column:
    """The integer at the start of a text, null only for null."""
    return F.when(text.isNotNull(), leading_int(text.cast("string")))


def identity(p: Payload) -> Column:
    alternates = F.concat(
        F.transform(p.items("sources.openalex.alternate_titles", {"title": "string"}), lambda x: x["title"]),
        F.transform(p.items("sources.wikidata.titles", {"title": "string"}), lambda x: x["title"]),
    )
    first_alternate = F.get(p.items("sources.openalex.alternate_titles", {"title": "string"}), F.lit(0))["title"]
    site = F.get(p.items("sources.wikidata.websites", {"url": "string"}), F.lit(0))["url"]
    return F.struct(
        p.get("unified.canonical_name").alias("title"),
        F.coalesce(p.get("sources.wikidata.main.iso4_abbreviation"), p.get("sources.wikidata.main.short_name"), first_alternate).alias("abbreviation"),
        p.get("unified.issn_l").alias("issn_l"),
        F.transform(p.items("issn_details", {"issn": "string"}), lambda x: x["issn"]).alias("issns"),
        F.slice(F.array_distinct(F.array_compact(alternates)), 1, ALTERNATE_TITLES).alias("alternate_titles"),
        p.get("unified.openalex_id").alias("openalex_id"),
        F.coalesce(p.get("unified.openalex_type"), p.get("sources.openalex.main.type")).alias("openalex_type"),
        p.get("unified.wikidata_qid").alias("wikidata_qid"),
        p.get("cover.cover_url").alias("cover_url"),
        p.get("cover.original_url").alias("cover_original_url"),
        F.coalesce(p.get("sources.openalex.main.homepage_url"), site).alias("homepage_url"),
    )


def publication(p: Payload) -> Column:
    oa = "sources.openalex.main."
    return F.struct(
        F.coalesce(p.get("unified.crossref_publisher"), p.get("unified.doaj_publisher"), p.get(oa + "host_organization_name")).alias("publisher_name"),
        p.get(oa + "host_organization").alias("publisher_id"),
        F.coalesce(p.get("unified.openalex_country"), p.get("unified.doaj_country"), p.get(oa + "country_code")).alias("country_code"),
        F.coalesce(p.get("unified.wikidata_country"), p.get("unified.scimago_country"), p.get("sources.wikidata.main.country_label")).alias("country_name"),
        p.get(oa + "first_publication_year", "int").alias("first_publication_year"),
        p.get(oa + "last_publication_year", "int").alias("last_publication_year"),
        p.get(oa + "is_core", "boolean").alias("is_core"),
    )


def metrics(p: Payload) -> Column:
    oa = "sources.openalex.main."
    pick = lambda u, o, t: F.coalesce(p.get("unified." + u, t).cast(t), p.get(oa + o, t).cast(t))
    counts = p.items(
        "sources.openalex.counts_by_year",
        {"year": "bigint", "works_count": "bigint", "oa_works_count": "bigint", "cited_by_count": "bigint"},
    )
    counts = F.filter(counts, lambda x: x["works_count"].isNotNull())
    recent = F.slice(latest_first(counts, lambda x: x["year"]), 1, RECENT_YEARS)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return F.struct(
        pick("openalex_works_count", "works_count", "bigint").alias("works_count"),
        p.get(oa + "oa_works_count", "bigint").alias("oa_works_count"),
        pick("openalex_cited_by_count", "cited_by_count", "bigint").alias("cited_by_count"),
        pick("openalex_h_index", "summary_stats_h_index", "bigint").alias("h_index"),
        pick("openalex_i10_index", "summary_stats_i10_index", "bigint").alias("i10_index"),
        pick("openalex_2yr_mean_citedness", "summary_stats_2yr_mean_citedness", "double").alias("two_year_mean_citedness"),
        F.transform(
            recent,
            lambda x: F.struct(
                x["year"].alias("year"),
                *(zero(x[c]).alias(c) for c in ("works_count", "oa_works_count", "cited_by_count")),
            ),
        ).alias("counts_by_year"),
    )


def jcr(p: Payload) -> Column:
    fields = dict.fromkeys(("year", "impact_factor", "if_quartile", "if_rank", "category", "quartile", "value"), "string")
    rows, any_ = history(p, "jcr", fields)
    one = lambda x: F.struct(
        leading_or_null(x["year"]).alias("year"),
        F.coalesce(x["impact_factor"], x["value"]).alias("impact_factor"),
        F.coalesce(x["if_quartile"], x["quartile"]).alias("quartile"),
        x["if_rank"].alias("rank"),
        x["category"].alias("category"),
    )
    return F.when(any_, F.transform(rows, one))


def scimago(p: Payload) -> Column:
    plain = ("h_index", "total_docs_year", "total_docs_3years", "total_refs", "total_citations_3years", "citable_docs_3years", "overton", "sdg", "categories")
    numbers = ("citations_per_doc_2years", "ref_per_doc", "female_pct")
    fields = dict.fromkeys(("year", "sjr", "value", "sjr_best_quartile", "quartile", *plain, *numbers), "string")
    rows, any_ = history(p, "scimago", fields)
    one = lambda x: F.struct(
        leading_or_null(x["year"]).alias("year"),
        decimal_comma(F.coalesce(x["sjr"], x["value"])).alias("sjr"),
        F.coalesce(x["sjr_best_quartile"], x["quartile"]).alias("best_quartile"),
        *(x[c].alias(c) for c in plain),
        *(decimal_comma(x[c]).alias(c) for c in numbers),
    )
    return F.when(any_, F.transform(rows, one))


def cas_partition(p: Payload) -> Column:
    subs = [f"subcategory_{i}" for i in range(1, SUBCATEGORIES + 1)]
    main = ("year", "major_category", "major_quartile", "top", "web_of_science", "open_access", "quartile")
    fields = dict.fromkeys((*main, *subs, *(f"{s}_quartile" for s in subs)), "string")
    rows, any_ = history(p, "fqb", fields)

    def one(x: Column) -> Column:
        minors = F.array(*(F.struct(x[s].alias("category"), x[f"{s}_quartile"].alias("quartile")) for s in subs))
        return F.struct(
            leading_or_null(x["year"]).alias("year"),
            x["major_category"].alias("major_category"),
            F.coalesce(x["major_quartile"], x["quartile"]).alias("major_quartile"),
            x["top"].alias("top"),
            x["web_of_science"].alias("web_of_science"),
            x["open_access"].alias("open_access"),
            F.filter(minors, lambda m: ~is_blank(m["category"])).alias("minor_categories"),
        )

    return F.when(any_, F.transform(rows, one))


def warning(p: Payload) -> Column:
    rows, any_ = history(p, "gjqk", dict.fromkeys(("year", "warning_level", "warning_reason", "level", "reason"), "string"))
    one = lambda x: F.struct(
        leading_or_null(x["year"]).alias("year"),
        F.coalesce(x["warning_level"], x["level"]).alias("level"),
        F.coalesce(x["warning_reason"], x["reason"]).alias("reason"),
    )
    return F.when(any_, F.transform(rows, one))


def open_access(p: Payload) -> Column:
    b = lambda path: _bool(p, path)
    oa, dj = "sources.openalex.main.", "sources.doaj.main."
    return F.struct(
        first_truthy(b("unified.openalex_is_oa"), b(oa + "is_oa")).alias("is_oa"),
        first_truthy(b("unified.doaj_is_in_doaj"), b(oa + "is_in_doaj")).alias("is_in_doaj"),
        first_truthy(b("unified.doaj_has_apc"), b(dj + "apc_has_apc")).alias("has_apc"),
        b("sources.scimago.main.open_access_diamond").alias("diamond_oa"),
        b(dj + "boai").alias("boai"),
        b(dj + "copyright_author_retains").alias("copyright_author_retains"),
        b(dj + "plagiarism_detection").alias("plagiarism_detection"),
        b(dj + "preservation_has_preservation").alias("has_preservation"),
        b(dj + "deposit_policy_has_policy").alias("has_deposit_policy"),
        b(dj + "waiver_has_waiver").alias("has_waiver"),
        b(dj + "other_charges_has_other_charges").alias("has_other_charges"),
        p.get(dj + "publication_time_weeks", "bigint").cast("bigint").alias("publication_time_weeks"),
        F.transform(p.items("sources.doaj.licenses", {"type": "string", "license_type": "string"}), lambda x: F.coalesce(x["type"], x["license_type"])).alias("licenses"),
        p.get("sources.fqb.main.review").alias("cas_review"),
        p.get("sources.fqb.main.oaj").alias("cas_oaj"),
        p.get("sources.fqb.main.top").alias("cas_top"),
    )


def _bool(p: Payload, path: str) -> Column:
    kind = p.type_of(path)
    if kind is None:
        return F.lit(None).cast("boolean")
    return F.col(path) if isinstance(kind, T.BooleanType) else tri_state(F.col(path))


def subjects_topics(p: Payload) -> Column:
    topics = p.items(
        "sources.openalex.topics",
        {"display_name": "string", "count": "bigint", "score": "double", "field_display_name": "string", "domain_display_name": "string"},
    )
    shares = p.items("sources.openalex.topic_shares", {"display_name": "string", "value": "double", "field_display_name": "string", "domain_display_name": "string"})
    named = F.slice(F.filter(topics, lambda x: x["display_name"].isNotNull()), 1, TOPICS)
    shared = F.slice(F.filter(shares, lambda x: x["display_name"].isNotNull() & x["value"].isNotNull()), 1, TOPICS)
    rename = lambda *extra: lambda x: F.struct(
        x["display_name"].alias("name"), *(x[c].alias(c) for c in extra), x["field_display_name"].alias("field"), x["domain_display_name"].alias("domain")
    )
    return F.struct(
        F.transform(named, rename("count", "score")).alias("topics"),
        F.transform(shared, rename("value")).alias("topic_shares"),
        F.array_compact(F.transform(p.items("sources.doaj.keywords", {"keyword": "string"}), lambda x: x["keyword"])).alias("keywords"),
        F.array_compact(F.transform(p.items("sources.doaj.subjects", {"term": "string", "code": "string"}), lambda x: F.coalesce(x["term"], x["code"]))).alias("subjects"),
    )


COVERAGE = ("abstracts", "references", "orcids", "funders", "licenses", "affiliations")


def whole_percents(shares: Column) -> Column:
    """A map of shares as whole per cents, without those that are missing or not positive."""
    return F.transform_values(F.map_filter(shares, lambda _, v: F.coalesce(v > 0, F.lit(False))), lambda _, v: F.round(v * 100, 0).cast("int"))


def crossref_quality(p: Payload) -> Column:
    dois = p.items("sources.crossref.dois_by_year", {"year": "bigint", "count": "bigint"})
    dois = F.slice(latest_first(F.filter(dois, lambda x: x["count"].isNotNull()), lambda x: x["year"]), 1, RECENT_YEARS)
    types = p.items("sources.crossref.coverage_types", {"type_name": "string"} | dict.fromkeys(COVERAGE, "double"))
    every = F.get(F.filter(types, lambda x: x["type_name"] == "all"), F.lit(0))
    shares = F.map_from_arrays(F.array(*map(F.lit, COVERAGE)), F.array(*(every[c] for c in COVERAGE)))
    coverage = F.when(every.isNotNull(), whole_percents(shares))
    return F.when(
        p.get("sources.crossref").isNotNull(),
        F.struct(
            p.get("sources.crossref.main.counts_total_dois", "bigint").alias("total_dois"),
            p.get("sources.crossref.main.counts_current_dois", "bigint").alias("current_dois"),
            dois.alias("dois_by_year"),
            coverage.alias("coverage"),
        ),
    )


# The fields of the review and ranking sources and what they become.
SCIREV = {
    "first_review_round_months": "first_review_months", "total_handling_months": "total_handling_months",
    "immediate_rejection_days": "immediate_rejection_days", "avg_review_rounds": "avg_review_rounds",
    "avg_review_reports": "avg_review_reports", "report_difficulty": "report_difficulty",
    "report_quality": "report_quality", "overall_rating": "overall_rating", "review_count": "review_count",
}
CCF = {"ccf_rank": "rank", "field": "field", "ccf_category": "category", "abbreviation": "abbreviation", "source_type": "source_type"}


def _renamed(p: Payload, source: str, names: dict[str, str]) -> Column:
    main = f"sources.{source}.main"
    return F.when(p.get(main).isNotNull(), F.struct(*(F.coalesce(p.get(f"{main}.{a}").cast("string"), p.get(f"{main}.{b}").cast("string")).alias(b) for a, b in names.items())))


def wikidata_meta(p: Payload) -> Column:
    labels = lambda path, *names: F.array_compact(
        F.transform(p.items(path, dict.fromkeys(names, "string")), lambda x: F.coalesce(*(x[n] for n in names)))
    )
    main = "sources.wikidata.main"
    return F.when(
        p.get(main).isNotNull(),
        F.struct(
            *(p.get(f"{main}.{a}").alias(b) for a, b in (("description_en", "description_en"), ("description_zh", "description_zh"), ("inception", "inception"), ("frequency_label", "frequency"), ("coden", "coden"))),
            labels("sources.wikidata.indexed_in", "database_label").alias("indexed_in"),
            labels("sources.wikidata.editors", "editor_label", "label").alias("editors"),
            labels("sources.wikidata.languages", "language_label", "label").alias("languages"),
        ),
    )


def preservation(p: Payload) -> Column:
    services = lambda path: F.array_compact(F.transform(p.items(path, {"service_name": "string"}), lambda x: x["service_name"]))
    kept, deposited = services("sources.doaj.preservation_services"), services("sources.doaj.deposit_policy_services")
    return F.when((F.size(kept) > 0) | (F.size(deposited) > 0), F.struct(kept.alias("preservation_services"), deposited.alias("deposit_services")))


def canonical_record(catalogue: DataFrame) -> DataFrame:
    """unified_id and the fourteen sections of every catalogue row."""
    p = Payload(catalogue.schema)
    return catalogue.select(
        F.col("unified.id").alias("unified_id"),
        identity(p).alias("identity"),
        publication(p).alias("publication"),
        metrics(p).alias("metrics"),
        jcr(p).alias("jcr"),
        scimago(p).alias("scimago"),
        cas_partition(p).alias("cas_partition"),
        warning(p).alias("warning"),
        open_access(p).alias("open_access"),
        subjects_topics(p).alias("subjects_topics"),
        crossref_quality(p).alias("crossref_quality"),
        _renamed(p, "scirev", SCIREV).alias("scirev"),
        _renamed(p, "ccf", CCF).alias("ccf"),
        wikidata_meta(p).alias("wikidata_meta"),
        preservation(p).alias("preservation"),
    )
