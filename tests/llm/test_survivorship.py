"""Field-by-field survivorship: ties, fillers, nulls and repeated rows."""

from shelfmark.llm.survivorship import best_values, surviving_records
from tests.llm.fixtures import catalogue


def best(spark, rows):
    return {(r.unified_id, r.field_name, r.best_value) for r in best_values(catalogue(spark, rows)).collect()}


def test_latest_filled_value_survives(spark):
    rows = [
        {"id": 1, "at": 5, "crossref_publisher": "Old", "openalex_country": "DE", "wikidata_country": "n/a"},
        {"id": 1, "at": 9, "crossref_publisher": "Germ...", "openalex_country": "XX", "wikidata_country": " "},
        {"id": 1, "at": 7, "crossref_publisher": "New", "openalex_country": "??", "scimago_country": "Chil (cut)"},
        {"id": 2, "at": 1, "crossref_publisher": "Alone"},
        {"id": None, "at": 1, "crossref_publisher": "No id"},
        {"id": None, "at": 2, "crossref_publisher": "No id"},
        None,
    ]
    assert best(spark, rows) == {(1, "crossref_publisher", "New"), (1, "openalex_country", "DE")}


def test_ties_and_repeated_rows(spark):
    rows = [{"id": 3, "at": 4, "crossref_publisher": "A"}, {"id": 3, "at": 4, "crossref_publisher": "B"}] * 2
    assert best(spark, rows) == {(3, "crossref_publisher", "B")}


def test_null_time_is_oldest(spark):
    rows = [{"id": 4, "at": None, "crossref_publisher": "Z"}, {"id": 4, "at": 1, "crossref_publisher": "A"}]
    assert best(spark, rows) == {(4, "crossref_publisher", "A")}
    only = [{"id": 5, "at": None, "crossref_publisher": "Z"}, {"id": 5, "at": 1}]
    assert best(spark, only) == {(5, "crossref_publisher", "Z")}


def test_empty_and_long(spark):
    assert best(spark, []) == set()
    long = "P" * 200_000
    assert best(spark, [{"id": 1, "at": 1, "crossref_publisher": long}] * 2) == {(1, "crossref_publisher", long)}


def test_record_prefers_trusted_sources(spark):
    rows = [
        {"id": 1, "at": 9, "doaj_publisher": "D", "host": "H", "openalex_country": "CL", "canonical_name": "N2"},
        {"id": 1, "at": 1, "crossref_publisher": "C", "wikidata_country": "Chile", "canonical_name": "N1"},
    ]
    r = surviving_records(catalogue(spark, rows)).first()
    assert (r.unified_id, r.n_rows, r.publisher, r.country, r.canonical_name) == (1, 2, "C", "Chile", "N2")
