"""Evaluation items that leak into a corpus, found through spaced seeds.

Words of items and documents are hashed. A seed is a fixed mask over a window
of words that ignores some positions, so a replaced word there does not hide
the match. The items' seed hashes are joined with the documents' ones; around
the hits an extension that tolerates replaced, lost and added words finds how
far item and document run together, and the pieces found are chained in the
item's order. A document is reported with an item if the chained pieces cover
at least half of the item's own words.

The items' seeds are joined with the documents' ones where the documents are:
an index of sorted seed hashes, built once, is sent to the tasks if the items
have no more than ``most_seeds`` seeds (a bound that is counted before anything
is collected). Beyond it nothing is collected: the documents' seeds that may
occur among the items' (by a bit table of fixed size) are exchanged and joined
with the items' seeds by hash, and each pair that meets is verified. Both ways
give the same pairs, as word frequencies are always those of all items.

Defined cases
-------------
* null, empty and very short texts leak nothing; items of fewer than five own words, the
  length of a seed, match nothing; shorter items than LEAST_PIECE words must be found whole;
* an item's stock instruction line is its first line where at least two items
  begin with the same line and more text follows;
* texts are compared without case, punctuation, markup references and invisible
  characters; Chinese and Japanese text counts character by character;
* repeated documents are reported under their own ids, a repeated item id once;
* documents are processed whole, however long.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import stored

# Masks over a window of words: 1 counts, 0 is ignored.
MASKS = ("11111", "1101011", "110011", "1010111")
COVERED = 0.5  # of the item's own words
LEAST_PIECE = 8  # words
LEAST_AGREED = 0.74  # of a piece's words, weighted by rarity among the items
LEAST_HITS = 3
_DROP = 5
_LOW = 2**22 - 1

# The format characters, from the character database.
_INVISIBLE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x20000) if unicodedata.category(chr(c)) == "Cf") + "]+")
_WORD = re.compile(r"[⺀-鿿぀-ヿ豈-﫿]|(?:(?![⺀-鿿぀-ヿ豈-﫿])[^\W_])+")


def words(text: str) -> list[str]:
    """The words of a text, folded; each CJK character is a word."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _INVISIBLE.sub("", text)
    return _WORD.findall(text.casefold())


class Hasher:
    """Hashes of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 2_000_000:
            known.clear()
        for w in set(texts).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, texts), np.uint64, len(texts))


def seeds(hashes: np.ndarray) -> list[np.ndarray]:
    """For each mask the seed hash at every position."""
    out = []
    for number, mask in enumerate(MASKS):
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.full(n, 0x9E3779B97F4A7C15 + number, np.uint64)
        for k, c in enumerate(mask):
            if c == "1":
                h = (h ^ hashes[k : k + n]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
        out.append(h)
    return out


def stock_lines(items: list[tuple[int, str]]) -> set[str]:
    """First lines that at least two items begin with."""
    firsts: dict[str, int] = defaultdict(int)
    for _, text in items:
        head, more, rest = text.partition("\n")
        if more and rest.strip():
            firsts[head.strip()] += 1
    return {line for line, n in firsts.items() if n >= 2}


def own_text(text: str, stock: set[str]) -> str:
    """An item's text without its stock instruction line."""
    head, more, rest = text.partition("\n")
    return rest if more and rest.strip() and head.strip() in stock else text


def _extend(a: list, b: list, i: int, j: int, step: int) -> tuple[int, int, list[int]]:
    """How far both run together from a hit, tolerating small edits, and which words of ``a`` agree."""
    score = best = kept = 0
    at_i, at_j = i, j
    agreed: list[int] = []
    while True:
        ni, nj = i + step, j + step
        if not (0 <= ni < len(a) and 0 <= nj < len(b)):
            break
        if a[ni] == b[nj]:
            score += 1
            i, j = ni, nj
            agreed.append(ni)
        else:
            score -= 1
            for da, db in ((1, 0), (0, 1), (2, 0), (0, 2)):
                p, q = ni + step * da, nj + step * db
                if 0 <= p + step < len(a) and 0 <= q + step < len(b) and a[p] == b[q] and a[p + step] == b[q + step]:
                    i, j = p, q
                    agreed.append(p)
                    break
            else:
                i, j = ni, nj
        if score > best:
            best, at_i, at_j, kept = score, i, j, len(agreed)
        elif score < best - _DROP:
            break
    return at_i, at_j, agreed[:kept]


def least_piece(own: list) -> int:
    """The words that a piece of an item needs; a short item has but one piece."""
    return min(LEAST_PIECE, len(own))


def coverage(a: list, b: list, hits: list[tuple[int, int]], weights: list[float]) -> tuple[float, int]:
    """The share of item ``a`` found in ``b`` in order, and in how many pieces.

    A piece counts if most of its words agree, rare words counting more: where
    only the stock phrases of two texts agree, names and numbers do not.
    """
    least = least_piece(a)
    pieces: list[tuple[int, int, int, int]] = []
    for i, j in sorted(hits):
        if any(p[0] <= i <= p[1] and p[2] <= j <= p[3] and abs((j - i) - (p[2] - p[0])) <= 8 for p in pieces):
            continue
        end_i, end_j, after = _extend(a, b, i, j, 1)
        start_i, start_j, before = _extend(a, b, i, j, -1)
        if end_i - start_i + 1 < least:
            continue
        agreed = sum(weights[k] for k in before) + sum(weights[k] for k in after) + (weights[i] if a[i] == b[j] else 0.0)
        if agreed >= LEAST_AGREED * sum(weights[start_i : end_i + 1]):
            pieces.append((start_i, end_i, start_j, end_j))
    pieces.sort(key=lambda p: (p[1], p[3]))
    best: list[tuple[int, int]] = []
    for n, p in enumerate(pieces):
        own = p[1] - p[0] + 1
        top = (own, 1)
        for m in range(n):
            q = pieces[m]
            if q[0] < p[0] and q[2] < p[2]:
                both = max(0, q[1] - p[0] + 1)
                if q[3] - p[2] + 1 <= both + 2 and best[m][0] + own - both > top[0]:
                    top = (best[m][0] + own - both, best[m][1] + 1)
        best.append(top)
    covered, count = max(best, default=(0, 0))
    return covered / len(a), count


def own_hashes(text: str, stock: bool, hasher: Hasher) -> np.ndarray:
    """The hashes of an item's own words; ``stock`` tells that its first line is a stock one."""
    return hasher(words(text.partition("\n")[2] if stock else text))


def weighted(ws: list[int], df: dict[int, int], n_items: int) -> list[float]:
    """The weight of each word of an item by its rarity among all items."""
    return [math.log(1 + n_items / df[w]) for w in ws]


class Index:
    """The items' seeds, sorted, with the item and position of each; built once and sent to the tasks."""

    def __init__(self, items: list[tuple[int, str]], stock: set[str]):
        hasher = Hasher()
        self.words = {n: hasher(words(own_text(t, stock))).tolist() for n, t in items}
        df = Counter(w for ws in self.words.values() for w in set(ws))
        self.weights = {n: weighted(ws, df, len(self.words)) for n, ws in self.words.items()}
        hashes, owners, places = [], [], []
        for number, ws in self.words.items():
            for s in seeds(np.array(ws, np.uint64)):
                hashes.append(s)
                owners.append(np.full(len(s), number, np.int64))
                places.append(np.arange(len(s), dtype=np.int32))
        order = np.argsort(np.concatenate(hashes), kind="stable") if hashes else np.empty(0, int)
        self.hash = np.concatenate(hashes)[order] if hashes else np.empty(0, np.uint64)
        self.item = np.concatenate(owners)[order] if hashes else np.empty(0, np.int64)
        self.place = np.concatenate(places)[order] if hashes else np.empty(0, np.int32)
        self._bits: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_bits": None}

    @property
    def bits(self) -> np.ndarray:
        """A bit table of the seeds' low bits, made once in each process."""
        if self._bits is None:
            self._bits = np.zeros(_LOW + 1, bool)
            self._bits[(self.hash & np.uint64(_LOW)).astype(np.int64)] = True
        return self._bits

    def find(self, hashes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """The hits of a document: item to (item position, document position)."""
        hits: dict[int, set] = defaultdict(set)
        if not len(self.hash):
            return {}
        for s in seeds(hashes):
            # A bit table of the seeds' low bits leaves few positions to search for.
            maybe = np.flatnonzero(self.bits[(s & np.uint64(_LOW)).astype(np.int64)])
            if not len(maybe):
                continue
            lo = np.searchsorted(self.hash, s[maybe])
            hit = self.hash[np.minimum(lo, len(self.hash) - 1)] == s[maybe]
            for j, k in zip(maybe[hit].tolist(), lo[hit].tolist(), strict=True):
                while k < len(self.hash) and self.hash[k] == s[j]:
                    hits[int(self.item[k])].add((int(self.place[k]), j))
                    k += 1
        return {n: list(h) for n, h in hits.items()}


def covered(own: list[int], weights: list[float], hits: list[tuple[int, int]], ws: list[int]) -> tuple[float, int] | None:
    """The share of an item that a document holds and the pieces, or None if it has not leaked."""
    # An item of n words has no more than n seeds of a mask; short ones have few.
    if len(hits) < min(LEAST_HITS, len(own) - len(MASKS[0]) + 1):
        return None
    # Hits must lie densely enough to cover half of the item at all.
    if len({i for i, _ in hits}) * 8 < len(own) * COVERED:
        return None
    share, count = coverage(own, ws, hits, weights)
    return (share, count) if share >= COVERED else None


def leaks_in(text: str, index: Index, hasher: Hasher) -> list[tuple[int, float, int]]:
    """The items that leaked into a text, with coverage and number of pieces."""
    hashes = hasher(words(text))
    found = index.find(hashes)
    ws = hashes.tolist() if found else []
    out = []
    for number, hits in found.items():
        if leak := covered(index.words[number], index.weights[number], hits, ws):
            out.append((number, *leak))
    return out


def hits_between(own: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int]]:
    """All hits between one item and one document."""
    hits: set[tuple[int, int]] = set()
    for a, b in zip(seeds(own), seeds(hashes), strict=True):
        at: dict[int, list[int]] = defaultdict(list)
        for i, h in enumerate(a.tolist()):
            at[h].append(i)
        for j in np.flatnonzero(np.isin(b, a)).tolist():
            hits.update((i, j) for i in at[int(b[j])])
    return list(hits)


def _usable(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items once each with their first ``line`` if more follows it, and the stock lines."""
    one = items.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates(["item_id"])
    first = F.substring_index("text", "\n", 1)
    rest = F.col("text").substr(F.length(first) + 1, F.length("text"))
    one = one.withColumn("line", F.when(F.length(F.trim(F.regexp_replace(rest, r"\s", ""))) > 0, F.trim(first)))
    return one, one.where("line is not null").groupBy("line").count().where("count >= 2").select("line")


def leaks(documents: DataFrame, items: DataFrame, most_seeds: int = 5_000_000) -> DataFrame:
    """Documents with the items that leaked into them.

    Returns doc_id, item_id, coverage, pieces. ``items`` are a held-out set; up
    to ``most_seeds`` seeds of them are sent to the tasks, more are joined.
    """
    spark = documents.sparkSession
    one, heads = _usable(items)
    some = documents.select("doc_id", "text").where("text is not null and doc_id is not null")
    # The bound: four seeds a word, and no text has more words than characters.
    size = one.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] * len(MASKS)
    if size > most_seeds:
        return _joined(some, one, heads)
    stock = {r["line"].strip() for r in heads.toLocalIterator()}
    index = Index([(r["item_id"], r["text"]) for r in one.orderBy("item_id").toLocalIterator()], stock)
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            rows = [
                (doc, *leak)
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True)
                for leak in leaks_in(text, shared.value, hasher)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage", "pieces"])

    return some.mapInPandas(run, "doc_id long, item_id long, coverage double, pieces int")


_TABLE = 2**25 - 1  # the bit table of the join: 4 MB, whatever the number of items


def _joined(documents: DataFrame, one: DataFrame, heads: DataFrame) -> DataFrame:
    """The same by a join of seed hashes, for any number of items."""
    spark = documents.sparkSession
    marked = one.join(heads.withColumn("stock", F.lit(True)), "line", "left").select("item_id", "text", F.coalesce("stock", F.lit(False)).alias("stock"))

    @F.pandas_udf("array<long>")
    def read(texts: pd.Series, stock: pd.Series) -> pd.Series:
        hasher = Hasher()
        return pd.Series([own_hashes(t, s, hasher).astype(np.int64) for t, s in zip(texts, stock, strict=True)])

    @F.pandas_udf("array<long>")
    def seeded(lists: pd.Series) -> pd.Series:
        return pd.Series([np.unique(np.concatenate(seeds(np.asarray(x, np.int64).astype(np.uint64)))).astype(np.int64) for x in lists])

    own = stored(marked.select("item_id", read("text", "stock").alias("words")), "items")
    n_items = own.count()
    each = own.select("item_id", F.posexplode("words").alias("pos", "word"))
    df = each.groupBy("word").agg(F.count_distinct("item_id").alias("df"))
    # As Python's math.log has it.
    weights = (
        each.join(df, "word").groupBy("item_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "df"))).alias("w"))
        .select("item_id", F.transform("w", lambda x: x["df"]).alias("dfs"))
    )
    item_seeds = stored(own.select("item_id", F.explode(seeded("words")).alias("seed")), "item-seeds")
    low = F.col("seed").bitwiseAND(F.lit(_TABLE))
    # The table is made where the seeds are: a few kilobytes for each slice of it that holds any.
    slices = item_seeds.select((low / 4096).cast("int").alias("slice"), (low % 4096).cast("int").alias("bit")).distinct()
    packed = slices.groupBy("slice").agg(F.collect_set("bit").alias("bits"))
    table = np.zeros(_TABLE + 1, bool)
    for r in packed.toLocalIterator():
        table[r["slice"] * 4096 + np.array(r["bits"])] = True
    shared = spark.sparkContext.broadcast(np.packbits(table))

    @F.pandas_udf("array<long>")
    def met(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, bits = Hasher(), np.unpackbits(shared.value).astype(bool)
        for texts in batches:
            out = []
            for text in texts:
                found = np.unique(np.concatenate(seeds(hasher(words(text)))))
                out.append(found[bits[(found & np.uint64(_TABLE)).astype(np.int64)]].astype(np.int64))
            yield pd.Series(out)

    some = documents.withColumn("__row", F.xxhash64("doc_id", "text")).dropDuplicates(["__row"])
    candidates = some.select("__row", F.explode(met("text")).alias("seed")).join(item_seeds, "seed").groupBy("__row", "item_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = candidates.join(some, "__row").join(own, "item_id").join(weights, "item_id")

    @F.pandas_udf("coverage double, pieces int")
    def verify(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for texts, lists, dfs in batches:
            out = []
            for text, ws, df in zip(texts, lists, dfs, strict=True):
                a, b = np.asarray(ws, np.int64).astype(np.uint64), hasher(words(text))
                found = covered(a.tolist(), [math.log(1 + n_items / d) for d in df], hits_between(a, b), b.tolist())
                out.append(found or (None, None))
            yield pd.DataFrame(out, columns=["coverage", "pieces"]).astype({"coverage": "Float64", "pieces": "Int32"})

    out = pairs.withColumn("x", verify("text", "words", "dfs")).where("x.coverage is not null")
    found = out.select("__row", "item_id", "x.coverage", "x.pieces")
    # Repeated rows of a document get their pairs back.
    every = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("__row"))
    return every.join(found, "__row").select("doc_id", "item_id", "coverage", "pieces")
