"""The queries of the training-data problems and the SQL that checks them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import entity_match, format_duplicates, leakage, mojibake, name_links, packing, survivorship
from shelfmark.llm.name_rules import FILLERS
from shelfmark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return name_links.variant_pairs(table(spark, d, "catalogue"))


def p1_variants(spark: SparkSession, d: str) -> DataFrame:
    return name_links.variants(table(spark, d, "catalogue"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.best_values(table(spark, d, "catalogue"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.surviving_records(table(spark, d, "catalogue"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.both_tables(table(spark, d, "topics"), table(spark, d, "catalogue"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.members(_names(spark, d))


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.collapsed(_names(spark, d))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "topics"), table(spark, d, "topic_custom_fields"), table(spark, d, "catalogue")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.matches(*_sides(spark, d))


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    sides = _sides(spark, d)
    return entity_match.confident(entity_match.matches(*sides), *sides)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), table(spark, d, "capacities"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, d), table(spark, d, "capacities"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id", F.round("coverage", 4).alias("coverage"), "pieces")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.affected(table(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_variants, p3_found, p3_records, p4_found, p4_copies, p5_found, p5_confidence,
            p6_containers, p6_fill, p7_found, p7_leaks, p8_found, p8_restored,
        )
    }


def _sql_filled(col: str) -> str:
    fillers = ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(FILLERS))
    edge = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"
    cut = r"(\.\.\.|…|\[\.\.\.\]|\[…\]|\(cut\)|\(truncated\))[\s\p{Z}]*$"
    return (
        f"({col} IS NOT NULL AND regexp_matches({col}, '[\\p{{L}}\\p{{N}}]')"
        f" AND lower(regexp_replace({col}, '{edge}', '', 'g')) NOT IN ({fillers})"
        f" AND NOT regexp_matches({col}, '{cut}', 'i'))"
    )


def _p3_found_sql() -> str:
    parts = []
    for f in survivorship.FIELDS:
        parts.append(
            f"SELECT unified_id, '{f}' AS field_name, best_value FROM (SELECT unified.id AS unified_id,"
            f" unified.{f} AS best_value, row_number() OVER (PARTITION BY unified.id ORDER BY fetched_at DESC NULLS LAST,"
            f" unified.{f} DESC) AS rn FROM catalogue WHERE unified.id IN (SELECT unified.id FROM catalogue"
            f" GROUP BY unified.id HAVING count(*) >= 2) AND {_sql_filled(f'unified.{f}')}) WHERE rn = 1"
        )
    return " UNION ALL ".join(parts)


def _p3_records_sql() -> str:
    def best(name: str, sources: list[tuple[str, int]]) -> str:
        rows = " UNION ALL ".join(
            f"SELECT unified.id AS k, {p} AS p, fetched_at AS t, {e} AS v FROM catalogue WHERE {_sql_filled(e)}" for e, p in sources
        )
        return (
            f"{name}_best AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC,"
            f" t DESC NULLS LAST, v DESC) AS rn FROM ({rows})) WHERE rn = 1)"
        )

    host = "sources.openalex.main.host_organization_name"
    fields = {
        "canonical_name": [("unified.canonical_name", 0)],
        "issn_l": [("unified.issn_l", 0)],
        "publisher": [("unified.crossref_publisher", 3), (host, 2), ("unified.doaj_publisher", 1)],
        "country": [
            ("unified.wikidata_country", 4), ("unified.scimago_country", 3),
            ("unified.openalex_country", 2), ("unified.doaj_country", 1),
        ],
    }
    ctes = ", ".join(best(n, s) for n, s in fields.items())
    joins = " ".join(f"LEFT JOIN {n}_best ON {n}_best.k = g.k" for n in fields)
    cols = ", ".join(f"{n}_best.v AS {n}" for n in fields)
    return (
        f"WITH g AS (SELECT unified.id AS k, count(*) AS n_rows FROM catalogue WHERE unified.id IS NOT NULL GROUP BY 1),"
        f" {ctes} SELECT g.k AS unified_id, g.n_rows, {cols} FROM g {joins}"
    )


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _p3_found_sql(), "p3_records": _p3_records_sql()}
