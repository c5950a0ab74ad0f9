"""Leaks: planted passages, a plain comparison on whole tables and defined cases."""

import random
from difflib import SequenceMatcher

import pytest

from shelfmark.llm import leakage
from tests.llm.fixtures import documents

VOCABULARY = [f"w{i}" for i in range(500)]


def item(seed, n=100):
    rng = random.Random(seed)
    return [rng.choice(VOCABULARY) for _ in range(n)]


def run(spark, docs, items, **options):
    d = documents(spark, docs)
    i = spark.createDataFrame([(n, t, "x") for n, t in items], "item_id bigint, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in leakage.leaks(d, i, **options).collect()}


OTHER = " ".join(item(99, 60))
A, B = item(1), item(2)
STOCK = "Read this and answer.\n"
ITEMS = [(1, STOCK + " ".join(A)), (2, STOCK + " ".join(B)), (3, None), (4, ""), (1, STOCK + " ".join(A)), (None, "x y z")]


def edited(words, step=9):
    return [w if i % step else "changed" for i, w in enumerate(words)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (" ".join(A), {1}),
        (OTHER + " " + " ".join(A[30:90]).upper() + ". " + OTHER, {1}),
        (" ".join(A[:40]), set()),
        (" ".join(A[:30]) + " " + OTHER + " " + " ".join(A[40:70]), {1}),
        (" ".join(A[40:70]) + " " + OTHER + " " + " ".join(A[:30]), set()),
        (" ".join(edited(A)), {1}),
        ("* " + "\n* ".join(" ".join(A[i : i + 10]) + "," for i in range(0, 100, 10)) + "&amp;", {1}),
        (" ".join(A) + " " + " ".join(B), {1, 2}),
        ("Read this and answer. " * 30, set()),
        ("", set()),
        (None, set()),
        ("w1 w2", set()),
    ],
)
def test_planted(spark, text, found):
    assert run(spark, [(7, text)], ITEMS) == {(7, n) for n in found}


def test_repeated_documents_and_long_texts(spark):
    long = OTHER + " " + " ".join(item(5, 60_000)) + " " + " ".join(A)
    assert run(spark, [(1, long), (2, long), (2, long)], ITEMS) == {(1, 1), (2, 1)}


def test_blocks_of_items_find_the_same(spark):
    docs = [(1, " ".join(A)), (2, " ".join(B))]
    assert run(spark, docs, ITEMS, most_seeds=100) == {(1, 1), (2, 2)}


def test_joined_seeds_find_the_same_near_one_half(spark):
    """Items of many sizes, leaked by 40 to 60 per cent, in one piece or two, with edits, some of the documents twice."""
    rng = random.Random(8)
    items = [(n, STOCK * (n % 2) + " ".join(item(n, 12 + 7 * n))) for n in range(1, 25)]
    docs = []
    for n, text in items:
        own = text.removeprefix(STOCK).split()
        for part in (0.4, 0.46, 0.5, 0.54, 0.6):
            k = int(len(own) * part)
            pieces = [own[:k]] if n % 3 else [own[: k // 2], own[-(k - k // 2) :]]
            words = f" {OTHER} ".join(" ".join(w if rng.random() > 0.03 else "changed" for w in p) for p in pieces)
            docs.append((len(docs), OTHER + " " + words + " " + OTHER))
    docs += docs[:7] + [(900, None), (901, "")]
    sent, joined = run(spark, docs, items), run(spark, docs, items, most_seeds=1)
    assert sent == joined and 24 < len(sent) < 96
    d = documents(spark, docs)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    full = lambda most: sorted((r.doc_id, r.item_id, round(r.coverage, 9), r.pieces) for r in leakage.leaks(d, i, most_seeds=most).collect())
    assert full(10**9) == full(1)


def test_short_items(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta"), (2, "one two three four"), (3, "v w x y z")]
    docs = [(1, "so Alpha, beta gamma delta epsilon zeta eta!"), (2, "alpha beta gamma delta"), (3, "one two three four"), (4, "u v w x y z")]
    for most in (10**6, 1):
        assert run(spark, docs, items, most_seeds=most) == {(1, 1), (4, 3)}


def test_whole_tables_joined_and_sent(spark, data):
    d, e = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    pairs = lambda most: {(r.doc_id, r.item_id) for r in leakage.leaks(d, e, most_seeds=most).collect()}
    assert pairs(1) == pairs(5_000_000)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == set()
    assert run(spark, [(1, "a b c")], []) == set()


def test_chinese_counts_by_character(spark):
    rng = random.Random(4)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120))
    assert run(spark, [(1, "前言" + text[:80] + "。"), (2, text[:40])], [(5, text)]) == {(1, 5)}


def test_whole_tables_against_plain_matching(spark, data):
    d, e = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, e).collect()}
    items = [(r.item_id, r.text) for r in e.collect()]
    stock = leakage.stock_lines(items)
    own = {n: leakage.words(leakage.own_text(t, stock)) for n, t in items}
    expected = set()
    for r in d.where("text is not null").collect():
        ws = leakage.words(r.text)
        there = set(zip(ws, ws[1:], ws[2:], strict=False))
        for n, a in own.items():
            grams = list(zip(a, a[1:], a[2:], strict=False))
            if sum(g in there for g in grams) < 0.3 * len(grams):
                continue
            blocks = SequenceMatcher(None, a, ws, autojunk=False).get_matching_blocks()
            if sum(b.size for b in blocks if b.size >= 4) >= 0.45 * len(a):
                expected.add((r.doc_id, n))
    assert got == expected
