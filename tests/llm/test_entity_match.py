"""Matching topics with catalogue ids: rules, namesakes, series and defined cases."""

import pytest

from shelfmark.llm.entity_match import _spread, confident, matches, valid_issn
from shelfmark.llm.title_rules import read_title
from tests.llm.fixtures import catalogue, fields, topics


def main(title):
    return read_title(title)[0]["tokens"] if read_title(title) else []


@pytest.mark.parametrize(
    ("title", "tokens", "series"),
    [
        ("The Acta Limehino Geology", ["acta", "limehino", "geology"], ""),
        ("Acta Limehino Geology: Methods and Data", ["acta", "limehino", "geology"], ""),
        ("Acta Limehino Geology - Series C: New Series", ["acta", "limehino", "geology"], "c"),
        ("Quarte. of Statis. (Bidekade)", ["quarte.", "statis.", "bidekade"], ""),
        ("Études&nbsp;de_géographie X", ["etudes", "geographie", "x"], ""),
        ("  ", [], ""),
    ],
)
def test_reading(title, tokens, series):
    parts = read_title(title)
    assert (parts[0]["tokens"] if parts else []) == tokens
    assert (parts[0]["series"] if parts else "") == series


def run(spark, t, f, c):
    return {(r.topic_id, r.unified_id) for r in matches(topics(spark, t), fields(spark, f), catalogue(spark, c)).collect()}


FILL = [(i, f"Bulletin of Filler{i}ology (Namo{i}ri)") for i in range(900, 915)]


def test_variants_of_a_title(spark):
    t = [(1, "Acta Limehino Comparative Geology"), (2, "ACTA LIMEHINO COMPAR. GEOLO."), (3, "Acta Limehno Comparative Geology = Revista de Nutrición"),
         (4, "Acta Limehino Geology"), (5, "Acta Limehino Comparative Geology - Series B"), (6, None), (7, " "), *FILL]
    c = [{"id": 10, "canonical_name": "The Acta Limehino Comparative Geology: Theory and Practice"}, {"id": 11, "canonical_name": "Acta Limehino Comparative Geology, Series B"}, {"id": 12, "canonical_name": ""}, None]
    assert run(spark, t, [], c) == {(1, 10), (2, 10), (3, 10), (5, 11)}


def test_namesakes_fall_apart(spark):
    t = [(1, "Acta Limehino Geology"), (2, "Acta Limehino Geology"), (3, "Acta Limehino Geology"), *FILL]
    f = [(1, "publisher", "Univ. Pr. Maga Batese"), (1, "country", "Chile"), (2, "publisher", "Zasa & Penope"), (2, "country", "n/a"), (2, "issn_l", "4000-0559"), (3, "country", "N/A")]
    c = [
        {"id": 10, "canonical_name": "Acta Limehino Geology", "crossref_publisher": "University of Maga Batese Press", "openalex_country": "CL", "wikidata_country": "Chile", "scimago_country": "Peru"},
        {"id": 11, "canonical_name": "Acta Limehino Geology", "crossref_publisher": "Zasa & Penope Publishing Ltd.", "openalex_country": "JP", "issns": ["4000-0559", None]},
    ]
    assert run(spark, t, f, c) == {(1, 10), (2, 11)}


def test_one_journal_whatever_is_missing(spark):
    t = [(1, "Acta Limehino Geology"), (2, "Acta Limehino Geology"), *FILL]
    f = [(1, "publisher", "Zasa & Penope"), (None, "country", "Chile"), (2, None, "x"), (2, "country", None)]
    c = [{"id": 10, "canonical_name": "acta limehino geology", "crossref_publisher": "University of Maga Batese Press", "openalex_country": "CL"}] * 3
    assert run(spark, t, f, c) == {(1, 10), (2, 10)}


def test_empty_tables_and_long_titles(spark):
    assert run(spark, [], [], []) == set()
    long = "Acta " + " ".join(f"word{i}" for i in range(2000))
    assert run(spark, [(1, long), (2, "y" * 30_000)], [], [{"id": 5, "canonical_name": long.upper()}]) == {(1, 5)}


def test_identifiers(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("4000-0559",), ("40000559 ",), ("4000-0550",), ("0000-0000",), ("x",), (None,), ("ISSN 4015-100X",)], "v string")
    assert [r[0] for r in rows.select(valid_issn(F.col("v"))).collect()] == ["40000559", "40000559", None, None, None, None, "4015100X"]


def confidence(spark, f, c):
    t, f, c = topics(spark, [(1, "Acta Limehino Geology"), (2, "Acta Limehino Geology")]), fields(spark, f), catalogue(spark, c)
    return {r.topic_id: r.confidence for r in confident(matches(t, f, c), t, f, c).collect()}


def test_confidence_grows_with_agreement(spark):
    one = {"id": 10, "canonical_name": "Acta Limehino Geology", "issn_l": "4000-0559", "openalex_country": "CL"}
    agreed = confidence(spark, [(1, "issn_l", "4000-0559"), (1, "country", "Chile")], [one])
    assert agreed == {1: 1.0, 2: 0.5}
    partly = confidence(spark, [(1, "issn_l", "4000-0559"), (1, "country", "Peru"), (2, "country", "Chile"), (2, "issn_l", "4000-0559")], [one])
    assert 0.5 < partly[1] < partly[2] <= 1.0
    assert confidence(spark, [], [{**one, "issn_l": None, "openalex_country": None}]) == {1: 0.5, 2: 0.5}


def test_short_titles_meet(spark):
    t = [(1, "Zolamik"), (2, "Limehino Geology"), (3, "Limehino Gology"), (4, "Zolamik Geology"), *FILL, *((i, f"Geology of X{i}onia") for i in range(20, 32))]
    c = [{"id": 10, "canonical_name": "ZOLAMIK."}, {"id": 11, "canonical_name": "The Limehino Geology"}]
    assert run(spark, t, [], c) == {(1, 10), (2, 11), (3, 11)}


def test_common_keys_meet_by_a_third_word(spark):
    """Readings under a common key meet only where the word that tells them apart may be equal; no damaged one is lost."""
    names = [f"{a}{b}{c}" for a in ("lime", "doka", "guti", "pehu", "sora") for b in ("hi", "ba", "mu", "ke") for c in ("nole", "tadi")]
    damaged = {n: v for n, v in zip(names, [n[1] + n[0] + n[2:] for n in names[:8]] + [n[:2] + "x" + n[3:] for n in names[8:16]] + [n[0] + n[2:] for n in names[16:24]], strict=False)}
    t = [(i, f"Acta {n.title()} Geology") for i, n in enumerate(names)]
    c = [{"id": 100 + i, "canonical_name": f"Acta {damaged.get(n, n).title()} Geology"} for i, n in enumerate(names)]
    assert run(spark, t, [], c) == {(i, 100 + i) for i in range(len(names))}
    rows = spark.createDataFrame([(i, 1, 40, ["acta", n, "geology"]) for i, n in enumerate(names)], "node long, key long, df long, tokens array<string>")
    met = _spread(rows).selectExpr("node", "explode(meets) as meet")
    assert met.join(met.withColumnRenamed("node", "other"), "meet").where("node < other").select("node", "other").distinct().count() < 200
