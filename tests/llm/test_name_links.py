"""Organisation names: linking against all-pairs comparison, rules and defined cases."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import name_links
from shelfmark.llm.name_rules import alias_fits, compare, is_filled, read_name, within_one
from tests.llm.fixtures import catalogue

SAME = [
    ("University of Maga Batese Press", "Presses universitaires de Maga Batese"),
    ("University of Maga Batese Press", "Univ. Pr. Maga Batese"),
    ("University of Maga Batese Press", "MAGA BATESE UP"),
    ("University of Maga Batese Press", "Univrrsity of Maga  Batese Press"),
    ("Institute of Urban Agronomy, Academy of Tofo Damunu", "Inst. Agron. Tofo Damunu Acad."),
    ("Institute of Mechanics, Academy of Teri Fifiri", "Institut für Mechanics der Akademie Teri Fifiri"),
    ("Margaret Nibufivehu & Sons", "Nibufivehu & Sons (Peggy)"),
    ("Margaret Nibufivehu & Sons", "M. Nibufivehu & Sons"),
    ("Margaret Nibufivehu & Sons", "Nibufivehu Sons"),
    ("Zasa & Penope Publishing Ltd.", "Publishing House Penope & Zasa"),
    ("Zasa & Penope Publishing Ltd.", "Zasa & Penope"),
    ("Durarigafa Scientific Verlag GmbH", "Durarigafa Wissenschaftsverlag"),
    ("Dilo Lebefu Society for Mechanics", "Society for Mechanics (Dilo Lebefu)"),
    ("Ruko Dasemu Society for Geology", "Ruko Dasemu Sc. for Geology"),
    ("Dilo Lebefu Society for Mechanics (Turkey)", "The Dilo Lebefu Mechanics Society"),
]
DIFFERENT = [
    ("Vula Voneha Society for Clinical Linguistics", "Vula Voneha Society for Quantitative Toxicology"),
    ("University of Teri Fifiri Press", "Institute of Mechanics, Academy of Teri Fifiri"),
    ("Robert Korakilasu & Sons", "Institute of Botany, Academy of Kora Kilasu"),
    ("Robert Migisefiki & Sons", "Margaret Migisefiki & Sons"),
    ("Institute of Agronomy, Academy of Tofo Damunu", "Institute of Urban Agronomy, Academy of Tofo Damunu"),
    ("University of Maga Batese Press", "University of Nate Tenavu Press"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert compare(read_name(a), read_name(b)) >= name_links.LEAST_SIMILARITY


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert compare(read_name(a), read_name(b)) < name_links.LEAST_SIMILARITY


@pytest.mark.parametrize("value", [None, "", "  ", "n/a", "Unknown", "未知", "[s.n.]", "Editorial de la...", "Kefa (cut)", "Univ […]", "Gese [...]", "--"])
def test_no_names(value):
    assert not is_filled(value) and read_name(value) is None


def test_short_forms():
    tokens = read_name("Tadi Febepo Society for Electronics")["tokens"]
    assert alias_fits("TFBE", "acronym", tokens) and alias_fits("TadiEleFe", "brand", tokens)
    assert alias_fits("febepo", "group", tokens) and not alias_fits("GNPL", "acronym", tokens)


def test_within_one():
    assert within_one("abcd", "abdc") and within_one("abc", "abcd") and within_one("abc", "axc")
    assert not within_one("abcd", "badc") and not within_one("abc", "abcde")


def brute(names):
    read = {n: read_name(n) for n in names}
    full = {n: r for n, r in read.items() if r and not r["alias_only"]}
    nodes = {(r["kind"], r["given"], tuple(r["tokens"])) for r in full.values()}
    df = Counter(t for n in nodes for t in set(n[2]))
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    as_read = lambda n: {"kind": n[0], "given": n[1], "tokens": list(n[2])}
    for a, b in itertools.combinations(sorted(nodes), 2):
        if compare(as_read(a), as_read(b), df, lambda t: math.log(1 + len(nodes) / df.get(t, 1))) >= name_links.LEAST_SIMILARITY:
            parent[find(a)] = find(b)
    org = {n: find((r["kind"], r["given"], tuple(r["tokens"]))) for n, r in full.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(org), 2) if org[a] == org[b]}


def test_no_link_is_lost_against_all_pairs(spark, data):
    c = spark.read.parquet(f"{data}/catalogue.parquet")
    names = {n for r in name_links.publisher_rows(c).collect() for n in r.names}
    plain = {n for n in names if (r := read_name(n)) and not r["alias_only"]}
    got = {(r.name_a, r.name_b) for r in name_links.variant_pairs(c).collect()}
    assert {p for p in got if p[0] in plain and p[1] in plain} == brute(names)


def test_short_forms_join_by_brackets_and_company(spark):
    c = catalogue(
        spark,
        [
            {"id": 1, "crossref_publisher": "Tadi Febepo Society for Electronics (TFBE)", "doaj_publisher": "n/a"},
            {"id": 2, "crossref_publisher": "TFBE", "host": "Febepo Group"},
            {"id": 3, "crossref_publisher": "TadiEleFe", "host": "Tadi Febepo Society for Electronics"},
            {"id": 4, "crossref_publisher": "Febepo Group", "host": "Tadi Febepo Soc. Elect."},
            {"id": 5, "crossref_publisher": "Gese Nipava UP", "host": "GNPL"},
            None,
            {"id": 6},
        ],
    )
    got = {(r.name_a, r.name_b) for r in name_links.variant_pairs(c).collect()}
    one = ["Febepo Group", "TFBE", "Tadi Febepo Soc. Elect.", "Tadi Febepo Society for Electronics", "Tadi Febepo Society for Electronics (TFBE)", "TadiEleFe"]
    assert got == set(itertools.combinations(sorted(one), 2)) | {("GNPL", "Gese Nipava UP")}


def test_empty_and_overlong(spark):
    assert name_links.variant_pairs(catalogue(spark, [None])).count() == 0
    long = " ".join(f"word{i}" for i in range(3000))
    glued = "x" * 50_000
    c = catalogue(spark, [{"id": 1, "crossref_publisher": long, "doaj_publisher": long.upper()}, {"id": 2, "crossref_publisher": glued, "host": glued + " Press"}])
    got = {(r.name_a, r.name_b) for r in name_links.variant_pairs(c).collect()}
    assert (long.upper(), long) in got


def test_formatting_only_pairs(spark):
    c = catalogue(spark, [{"id": 1, "crossref_publisher": "Maga Batese UP", "doaj_publisher": "Maga  Batese UP ", "host": "MAGA BATESE UP"}] * 3)
    assert name_links.variant_pairs(c).count() == 3
    rows = {r.name: (r.n, r.n_names) for r in name_links.variants(c).collect()}
    assert rows["Maga Batese UP"] == (3, 3)


def test_candidates_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(40)]
    rows = [(i, "", "", rng.choices(words[: rng.choice((6, 40))], k=rng.choice((1, 2, 9)))) for i in range(120)]
    nodes = spark.createDataFrame([(*r, [1] * len(r[3])) for r in rows], "node bigint, kind string, given string, tokens array<string>, dfs array<int>")
    grams = {r.node: set(r.g) for r in nodes.select("node", name_links._grams(F.col("tokens")).alias("g")).collect()}
    df = Counter(g for x in grams.values() for g in x)
    weight = lambda x: sum((math.log(len(rows)) + 0.1 - math.log(df[g])) ** 2 for g in sorted(x) if df[g] > 1)
    share = lambda a, b: weight(grams[a] & grams[b]) - name_links.LEAST_OVERLAP * min(weight(grams[a]), weight(grams[b]))
    pairs = {p: share(*p) for p in itertools.combinations(sorted(grams), 2) if any(df[g] > 1 for g in grams[p[0]] & grams[p[1]])}
    got = {(r.node_a, r.node_b) for r in name_links.candidates(nodes).collect()}
    assert {p for p, x in pairs.items() if x > 1e-9} <= got <= {p for p, x in pairs.items() if x > -1e-9}
