"""What a record's page shows, as long tables without markup: cards, panels, ratings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalars import bare_url, clamp, first_digits, initials, is_blank, matched_or, thousands

DASH = "—"


def _long(record: DataFrame, groups: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """unified_id, card_group, label, value for each value that says something."""
    rows = F.array(
        *(F.struct(F.lit(g).alias("card_group"), F.lit(n).alias("label"), v.cast("string").alias("value")) for g, cards in groups.items() for n, v in cards.items())
    )
    there = F.filter(rows, lambda x: ~is_blank(x["value"]) & (x["value"] != DASH))
    return record.select("unified_id", F.explode(there).alias("x")).select("unified_id", "x.*")


def _joined(words: Column) -> Column:
    return F.array_join(words, ", ")


def info_cards(record: DataFrame) -> DataFrame:
    """The facts of a record by group: unified_id, card_group, label, value; blank ones are left out.

    Prices and charges are no part of it.
    """
    i, p, m, o, st = (F.col(c) for c in ("identity", "publication", "metrics", "open_access", "subjects_topics"))
    jcr, sjr, cas = (F.get(c, F.lit(0)) for c in ("jcr", "scimago", "cas_partition"))
    minor = F.transform(
        F.filter(cas["minor_categories"], lambda x: ~is_blank(x["category"])),
        lambda x: F.when(is_blank(x["quartile"]), x["category"]).otherwise(F.concat(x["category"], F.lit(" ("), x["quartile"], F.lit(")"))),
    )
    fields = F.array_distinct(
        F.filter(F.transform(st["topics"], lambda t: F.concat_ws(" > ", t["field"], t["domain"])), lambda x: x != "")
    )
    return _long(
        record,
        {
            "basic": {
                "issn_l": i["issn_l"], "issns": _joined(i["issns"]), "aliases": _joined(i["alternate_titles"]), "abbreviation": i["abbreviation"],
                "homepage": bare_url(i["homepage_url"]), "type": i["openalex_type"], "publisher": p["publisher_name"],
                "country": F.coalesce(p["country_name"], p["country_code"]), "works": thousands(m["works_count"]), "cited_by": thousands(m["cited_by_count"]),
                "oa_works": thousands(m["oa_works_count"]), "h_index": thousands(m["h_index"]), "i10_index": thousands(m["i10_index"]),
                "two_year_citedness": F.when(m["two_year_mean_citedness"].isNotNull(), F.format_string("%.3f", m["two_year_mean_citedness"])),
                "first_year": p["first_publication_year"], "last_year": p["last_publication_year"],
            },
            "access": {
                "licenses": _joined(F.array_distinct(F.array_compact(o["licenses"]))),
                "publication_time_weeks": o["publication_time_weeks"],
            },
            "ranking": {
                "subject_category": jcr["category"], "rank": jcr["rank"], "major_discipline": cas["major_category"], "wos_index": cas["web_of_science"],
                "minor_partitions": _joined(minor), "scimago_h_index": thousands(sjr["h_index"]), "total_docs_3years": thousands(sjr["total_docs_3years"]),
                "total_refs": thousands(sjr["total_refs"]), "total_citations_3years": thousands(sjr["total_citations_3years"]),
                "citable_docs_3years": thousands(sjr["citable_docs_3years"]), "scimago_categories": sjr["categories"],
            },
            "keywords": {"keywords": _joined(st["keywords"]), "subjects": _joined(st["subjects"]), "topic_fields": _joined(fields)},
        },
    )


def metric_cards(record: DataFrame) -> DataFrame:
    """The four ranking cards: unified_id, card, tier, value, level, warning.

    An unknown tier or impact factor is shown as '', an unknown SJR or zone as
    a dash; levels fall back to '1' and ranks to '?'.
    """
    latest = lambda c: F.get(F.col(c), F.lit(0))
    jcr, sjr, cas, warn, ccf = latest("jcr"), latest("scimago"), latest("cas_partition"), latest("warning"), F.col("ccf")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    zone = first_digits(cas["major_quartile"])
    none = F.lit(None).cast("string")

    def card(name: str, there: Column, tier: Column, value: Column, level: Column, warning: Column = none) -> Column:
        one = F.struct(F.lit(name).alias("card"), tier.alias("tier"), value.alias("value"), level.alias("level"), warning.alias("warning"))
        return F.when(there, one)

    cards = F.array(
        card("jcr", jcr.isNotNull(), text(jcr["quartile"]), text(jcr["impact_factor"]), matched_or(jcr["quartile"], r"(?i)Q(\d)", "1")),
        card("sjr", sjr.isNotNull(), text(sjr["best_quartile"]), F.when(sjr["sjr"].isNull(), DASH).otherwise(F.format_string("%.3f", sjr["sjr"])), matched_or(sjr["best_quartile"], r"(?i)Q(\d)", "1")),
        card("cas", cas.isNotNull(), F.coalesce(zone, F.lit(DASH)), F.when(jcr.isNull(), DASH).otherwise(text(jcr["impact_factor"])), text(zone), F.when(~is_blank(warn["level"]), warn["level"])),
        card("ccf", ccf.isNotNull(), text(ccf["rank"]), text(ccf["field"]), matched_or(ccf["rank"], r"(?i)([ABC])", "?")),
    )
    return record.select("unified_id", F.explode(F.array_compact(cards)).alias("x")).select("unified_id", "x.*")


def hero(record: DataFrame) -> DataFrame:
    """The head of a record's page: unified_id, initials, title, subtitle, pills, homepage, country."""
    i, p = F.col("identity"), F.col("publication")
    present = lambda c: F.when(~is_blank(c), c)
    pills = F.concat_ws(" | ", F.coalesce(present(i["openalex_type"]), F.lit("journal")), present(p["country_code"]), F.concat(F.lit("ISSN-L "), present(i["issn_l"])))
    return record.select(
        "unified_id", initials(i["title"]).alias("initials"), F.coalesce(present(i["title"]), F.lit("Unknown journal")).alias("title"),
        F.concat(p["publisher_name"], F.coalesce(F.concat(F.lit(" ("), present(p["publisher_id"]), F.lit(")")), F.lit(""))).alias("subtitle"),
        pills.alias("pills"), bare_url(i["homepage_url"]).alias("homepage"), F.coalesce(present(p["country_name"]), present(p["country_code"])).alias("country"),
    )


def indexing_panel(record: DataFrame) -> DataFrame:
    """Where a record is indexed and kept: unified_id, card_group, label, value."""
    w, k = F.col("wikidata_meta"), F.col("preservation")
    return _long(
        record,
        {
            "indexing": {
                "indexed_in": _joined(w["indexed_in"]), "preserved_by": _joined(k["preservation_services"]), "deposit_policy": _joined(k["deposit_services"]),
                "languages": _joined(w["languages"]), "editors": _joined(w["editors"]), "coden": w["coden"], "inception": w["inception"], "frequency": w["frequency"],
            }
        },
    )


def peer_review(record: DataFrame) -> DataFrame:
    """The review times and ratings of a record: unified_id, card_group, label, value.

    Shown only where the time to a first decision or to the end is known.
    """
    r = F.col("scirev")
    number = lambda c: F.format_string("%.1f", c.try_cast("double"))
    shown = record.where(r["first_review_months"].isNotNull() | r["total_handling_months"].isNotNull())
    known = lambda c, text: F.when(c.isNotNull(), text)
    return _long(
        shown,
        {
            "review": {
                "first_decision": known(r["first_review_months"], number(r["first_review_months"])),
                "total_handling": known(r["total_handling_months"], number(r["total_handling_months"])),
                "rating": known(r["overall_rating"], F.concat(number(r["overall_rating"]), F.lit("/5"))),
                "rounds": r["avg_review_rounds"], "reports": r["avg_review_reports"], "difficulty": r["report_difficulty"], "reviews": r["review_count"],
            }
        },
    )


def stars(rating: Column, most: int = 5) -> Column:
    """How full each star of a rating is, in whole per cent."""
    value = clamp(F.coalesce(rating.cast("double"), F.lit(0.0)), 0.0, float(most))
    return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.round(clamp(value - i, 0.0, 1.0) * 100, 0).cast("int"))


def bar_width(percent: Column, width: float = 200.0) -> Column:
    """How wide a progress bar is filled."""
    return F.round(clamp(F.coalesce(percent.cast("double"), F.lit(0.0)), 0.0, 100.0) / 100.0 * width, 1)
