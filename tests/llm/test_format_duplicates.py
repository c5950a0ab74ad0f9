"""Formatting duplicates against canonical strings, collisions and defined cases."""

import itertools
from collections import defaultdict

import numpy as np
import pytest

from shelfmark.llm import format_duplicates as fd
from tests.llm.fixtures import catalogue, topics

SAME = [
    ("Acta X: Y", "ACTA  x y"),
    ("Zeitschrift für Z", "Zeitschrift für Z"),
    ("Zeitschrift für Z", "Zeitschrift f&#252;r&nbsp;Z."),
    ("Ａｃｔａ　Ｂ", "acta b"),
    ("A B = C D", "C D / A B"),
    ("A B = C D", "c d — a b"),
    ("A B : C D", "A B C D"),
    ("A_B_=_C", "C | A B"),
    ("Straße", "STRASSE"),
    ("A​b­c", "abc"),
    ("Genetics &amp; Policy", "Genetics & Policy"),
    ("A = B = C", "C = A = B"),
]
DIFFERENT = [
    ("Études", "Etudes"), ("A B", "B A"), ("A B = C D", "B A = C D"), ("Acta", "The Acta"), ("A and B", "A & B"),
    ("A = B = C = D = E", "A = B = C = E = D"),
]


def key(name):
    return fd.name_keys([name], fd.Folding())[0]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert fd.same_name(a, b) and fd.same_name(b, a)
    ka, kb = key(a), key(b)
    assert ka[0] == kb[0] or ka[0] in kb[1] or kb[0] in ka[1]


@pytest.mark.parametrize(("a", "b"), DIFFERENT[:-1])
def test_different(a, b):
    assert not fd.same_name(a, b) and key(a)[0] != key(b)[0]


def test_many_parts_are_sorted():
    a, b = DIFFERENT[-1]
    assert fd.same_name(a, b) and key(a)[0] == key(b)[0]


def test_titles_of_five_parts_and_their_written_forms(spark):
    rows = [
        (1, "A b = C d = E f = G h = I j"), (2, "I J / G H / E F / C D / A B"), (3, "C d A b E f I j G h"), (4, "A b C d = E f G h = I j"),
        (5, "b A C d E f I j G h"), (6, "A = B = C = D = E = F"), (7, "fedcba"), (8, "ab = cd = ef = gh = i = k"), (9, "A b C d E f G h I j"),
    ]
    assert fd.same_name(rows[0][1], rows[2][1]) and not fd.same_name(rows[0][1], rows[4][1])
    table = spark.createDataFrame([("topics", *r) for r in rows], "tab string, id bigint, name string")
    got = {(r.first_id, r.member_id) for r in fd.members(table).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (1, 9), (6, 7)}


def test_written_forms_in_other_orders_meet_through_the_title(spark):
    rows = [(1, "A b C d E f"), (2, "C d E f A b"), (3, "E f = A b = C d"), (4, "b A C d E f"), (5, "B A = C D = E F")]
    table = spark.createDataFrame([("topics", *r) for r in rows], "tab string, id bigint, name string")
    assert {(r.first_id, r.member_id) for r in fd.members(table).collect()} == {(1, 2), (1, 3), (4, 5)}


def test_references_in_references():
    text = "Genetics &amp;amp;amp;amp;amp; Policy"
    assert fd.same_name(text, "Genetics & Policy") and key(text)[0] == key("Genetics Policy")[0]


def test_blank_names_have_no_key():
    assert fd.name_keys([None, "", " \t", "—", "[]"], fd.Folding()) == [None] * 5


def test_hash_is_the_polynomial_of_the_folded_text():
    text = "Ébc" * 500
    codes = [c + 1 for ch in text for c in fd.fold_char(ch)]
    h1 = sum(c * pow(fd._B1, i, fd._P1) for i, c in enumerate(codes)) % fd._P1
    h2 = sum(c * pow(fd._B2, i, fd._P2) for i, c in enumerate(codes)) % fd._P2
    assert key(text)[0] == h1 * 2**31 + h2
    assert np.array_equal(fd._powers(3, 101, 10), [pow(3, i, 101) for i in range(10)])


def brute(names):
    """Groups by canonical text, names without separators under the titles that they write out."""
    out = set()
    for tab in ("topics", "catalogue"):
        mine = {i: n for t, i, n in names if t == tab and n and fd.canonical(n)}
        orders = {}
        for n in mine.values():
            parts = [p for p in ("".join(map(chr, fd._stream(x))) for x in fd._SPLIT.split(fd.decoded(n))) if p]
            if 1 < len(parts) <= 4:
                for p in itertools.permutations(parts):
                    orders["".join(p)] = min("".join(q) for q in itertools.permutations(parts))
        groups = defaultdict(list)
        for i, n in mine.items():
            c = fd.canonical(n)
            groups[orders.get(c, c)].append(i)
        out |= {(tab, min(v), i) for v in groups.values() for i in v if i != min(v)}
    return out


def test_whole_tables_against_brute_force(spark, data):
    both = fd.both_tables(spark.read.parquet(f"{data}/topics.parquet"), spark.read.parquet(f"{data}/catalogue.parquet"))
    one = both.where("id is not null").groupBy("tab", "id").agg({"name": "min"}).toDF("tab", "id", "name")
    assert {tuple(r) for r in fd.members(both).collect()} == brute([tuple(r) for r in one.collect()])


def test_small_tables(spark):
    t = topics(spark, [(1, "A = B"), (2, "b a"), (3, None), (4, ""), (5, "x" * 100_000), (6, "X" * 100_000 + "!"), (None, "A = B"), (7, "A/B")])
    c = catalogue(spark, [{"id": 9, "canonical_name": "A = B"}, {"id": 9, "canonical_name": "a=b"}, {"id": 8, "canonical_name": "B = A"}, None])
    both = fd.both_tables(t, c)
    assert {tuple(r) for r in fd.members(both).collect()} == {("topics", 1, 2), ("topics", 1, 7), ("topics", 5, 6), ("catalogue", 8, 9)}
    copies = {(r.tab, r.first_id): (r.n_ids, r.n_rows) for r in fd.collapsed(both).collect()}
    assert copies[("catalogue", 8)] == (2, 3) and copies[("topics", 1)] == (3, 3)


def test_empty_tables(spark):
    both = fd.both_tables(topics(spark, []), catalogue(spark, []))
    assert fd.members(both).count() == 0 and fd.collapsed(both).count() == 0


def test_colliding_names_fall_apart(spark, monkeypatch):
    rows = spark.createDataFrame([("topics", 1, "aa"), ("topics", 2, "bb"), ("topics", 3, "B b"), ("topics", 4, "A a")], "tab string, id bigint, name string")
    real = fd.with_keys

    def all_alike(names, name_col="name"):
        from pyspark.sql import functions as F

        return real(names, name_col).withColumn("key", F.lit(1).cast("bigint"))

    monkeypatch.setattr(fd, "with_keys", all_alike)
    assert {tuple(r) for r in fd.members(rows).collect()} == {("topics", 1, 4), ("topics", 2, 3)}
