"""Packing: invariants, conflicts and defined cases."""

import random
from collections import Counter, defaultdict

import pytest

from shelfmark.llm import packing
from tests.llm.fixtures import documents

ROWS = "capacity_id int, purpose string, capacity_tokens int, block int"


def checked(rows, sizes, capacity):
    """Every item is placed once and whole, no bin overflows; the bins' contents."""
    bins, pieces = defaultdict(list), defaultdict(list)
    for b, doc, piece, start, size in rows:
        bins[b].append((doc, size))
        pieces[doc].append((piece, start, size))
    assert all(sum(s for _, s in v) <= capacity for v in bins.values())
    for doc, size in sizes.items():
        own = sorted(pieces[doc])
        assert sum(s for _, _, s in own) == size
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert len(own) == 1 or size > capacity
        assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:], strict=False))
    return bins


def test_random_blocks():
    rng = random.Random(5)
    for capacity in (64, 512):
        items = [(i, int(rng.paretovariate(1.2) * 20), rng.choice("abcde"), rng.randrange(400)) for i in range(800)]
        rows = packing.pack(items, capacity)
        bins = checked(rows, {i[0]: i[1] for i in items}, capacity)
        used = sum(i[1] for i in items) / (len(bins) * capacity)
        assert used > 0.9
        cluster = {i[0]: i[3] for i in items}
        limit = max(1, -(-max(Counter(cluster.values()).values()) // len(bins)))
        for v in bins.values():
            assert max(Counter(cluster[d] for d, _ in v).values()) <= limit


def test_best_fit_takes_the_tightest_bin():
    rows = packing.pack([(1, 60, None, 1), (2, 50, None, 2), (3, 40, None, 3), (4, 45, None, 4)], 100)
    where = {doc: b for b, doc, *_ in rows}
    assert where[1] == where[3] and where[2] == where[4]


def test_sources_share_containers():
    rows = packing.pack([(i, 20, "hot", i) for i in range(8)] + [(100 + i, 20, None, 100 + i) for i in range(8)], 100)
    per = Counter((b, doc < 100) for b, doc, *_ in rows)
    assert max(n for (_, hot), n in per.items() if hot) == 2


def test_hot_cluster_is_spread_evenly():
    rows = packing.pack([(i, 10, None, 7) for i in range(90)] + [(200 + i, 10, None, 200 + i) for i in range(90)], 100)
    per = Counter(b for b, doc, *_ in rows if doc < 200)
    assert len({b for b, *_ in rows}) == 18 and max(per.values()) == 5


def test_table(spark):
    text = "word " * 300
    d = documents(spark, [(1, text, "a"), (2, text, "a"), (3, "", None), (4, None, "b"), (5, "tiny", None), (6, "a" * 40_000, "c"), (7, text.upper(), "b"), (None, "x", "y"), (5, "tiny", None)])
    caps = spark.createDataFrame([(1, "p", 512, 1), (2, "q", None, 1), (3, "r", 0, 1), (4, "s", 2048, 1)], ROWS)
    rows = packing.containers(d, caps).collect()
    assert {r.capacity_id for r in rows} == {1, 4}
    assert {r.doc_id for r in rows} == {1, 2, 3, 5, 6, 7}
    enc = packing.encoding(packing.TOKENIZER)
    for cid, capacity in ((1, 512), (4, 2048)):
        mine = [r for r in rows if r.capacity_id == cid]
        fill = Counter()
        for r in mine:
            fill[r.container_id] += r.tokens
        assert max(fill.values()) <= capacity
        assert sum(r.tokens for r in mine if r.doc_id == 6) == len(enc.encode_ordinary("a" * 40_000))
        assert sum(r.doc_id == 5 for r in mine) == 2
        copies = [r.container_id for r in mine if r.doc_id in (1, 2, 7) and r.piece == 0]
        assert capacity == 2048 or len(set(copies)) == 3


def test_empty(spark):
    caps = spark.createDataFrame([(1, "p", 512, 1)], ROWS)
    assert packing.containers(documents(spark, []), caps).count() == 0
    assert packing.containers(documents(spark, [(1, "x")]), caps.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [1, 50])
def test_blocks_keep_all_rows(spark, data, blocks):
    d, caps = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/capacities.parquet")
    rows = packing.containers(d, caps, block_rows=max(1, d.count() // blocks))
    assert rows.select("capacity_id", "doc_id").distinct().count() == 3 * d.where("text is not null").count()
