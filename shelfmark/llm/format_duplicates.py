"""Names that differ only in formatting: one record each and its number of copies.

The characters of a batch of names go through one lookup table that skips
white space, punctuation and invisible characters and folds case, width and
composed letters; the code points that are left feed two polynomial hashes per
part of a name. No canonical string is built or exchanged: only the hashes
are. Names that meet under one hash are verified by a two-pointer comparison
that skips and folds as it goes.

A parallel title ("A = B") is its parts in any order: its key is the least
hash over the orders of its parts. A name with fewer separators equals such a
title if it is one of those orders written out. Titles of up to four parts list
the hashes of all orders. Longer ones are keyed by their parts in the order of
their hashes, and meet the names that write them out under a sum over
characters, which no order changes; those pairs are all verified.

Defined cases
-------------
* null names and names without a letter or digit belong to no group;
* names that are equal under the rules above form one group; letters with and
  without accents stay different, as does another order of words in a part;
* a title of any number of parts equals every order of its parts, written with
  all, some or none of the separators;
* repeated rows of one id count as copies but give one member;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import stored

_P1, _P2 = 2_147_483_647, 2_147_483_629
_B1, _B2 = 1_103_515_245, 1_597_334_677
_ALWAYS, _SPACED = 1, 2  # kinds of separator: anywhere; only between white space


class Folding:
    """The lookup table from code points to what they fold to, filled as they occur."""

    def __init__(self) -> None:
        self.size = np.full(0x110000, 255, np.uint8)
        self.at = np.zeros(0x110000, np.int32)
        self.pool = np.zeros(1024, np.int64)
        self.used = 0
        self.separator = np.zeros(0x110000, np.uint8)
        self.space = np.zeros(0x110000, bool)

    def learn(self, codes: np.ndarray) -> None:
        for code in np.unique(codes[self.size[codes] == 255]).tolist():
            char = chr(code)
            self.space[code] = char.isspace() or char in "_＿" or unicodedata.category(char) == "Cf"
            wide = unicodedata.normalize("NFKC", char)
            self.separator[code] = _ALWAYS if wide in ("=", "/", "|") else _SPACED if wide in (":", "—") else 0
            out = [] if 0xD800 <= code < 0xE000 else fold_char(char)
            if self.used + len(out) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(out)] = out
            self.at[code], self.size[code] = self.used, len(out)
            self.used += len(out)


def fold_char(char: str) -> list[int]:
    """The letters, digits and marks that a character folds to."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", char).casefold())
    return [ord(c) for c in text if unicodedata.category(c)[0] in "LNM"]


def decoded(name: str) -> str:
    """The name with character references replaced; most names have none."""
    if "&" in name or "＆" in name:
        while (text := html.unescape(unicodedata.normalize("NFKC", name))) != name:
            name = text
    return name


def _powers(base: int, mod: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.int64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * pow(base, done, mod) % mod
        done += step
    return out


def _join(parts) -> tuple[int, int]:
    """The hash of parts written one after the other."""
    h1 = h2 = n = 0
    for a, b, size in parts:
        h1 = (h1 + a * pow(_B1, n, _P1)) % _P1
        h2 = (h2 + b * pow(_B2, n, _P2)) % _P2
        n += size
    return h1, h2


LISTED = 4  # parts of a title of which all orders are listed


def name_keys(names: list[str | None], table: Folding) -> list[tuple[int, list[int], int, int] | None]:
    """For each name its key, the hashes of all orders of up to LISTED parts, the sum over its characters, its parts."""
    texts = [decoded(x) if x else "" for x in names]
    raw = [x.encode("utf-32-le", "surrogatepass") for x in texts]
    codes = np.frombuffer(b"".join(raw), np.uint32).astype(np.int64)
    out: list[tuple[int, list[int], int, int] | None] = [None] * len(names)
    if not len(codes):
        return out
    table.learn(codes)
    row = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
    kind = table.separator[codes]
    blank = table.space[codes]
    before = np.concatenate([[True], blank[:-1]])
    after = np.concatenate([blank[1:], [True]])
    breaks = (kind == _ALWAYS) | ((kind == _SPACED) & before & after)
    segment = np.cumsum(breaks | np.concatenate([[True], row[1:] != row[:-1]])) - 1
    size = table.size[codes].astype(np.int64)
    total = int(size.sum())
    if not total:
        return out
    start = np.cumsum(size) - size
    take = np.repeat(table.at[codes].astype(np.int64) - start, size) + np.arange(total)
    folded = table.pool[take] + 1
    seg = np.repeat(segment, size)
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    length = np.diff(np.concatenate([first, [total]]))
    place = np.arange(total) - np.repeat(first, length)
    top = int(length.max())
    h1 = np.add.reduceat(folded * _powers(_B1, _P1, top)[place] % _P1, first) % _P1
    h2 = np.add.reduceat(folded * _powers(_B2, _P2, top)[place] % _P2, first) % _P2
    mixed = (folded.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (folded.astype(np.uint64) << np.uint64(29))
    bags = np.add.reduceat((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9), first)
    owner = row[np.searchsorted(segment, seg[first])]
    bounds = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
    for lo, hi in itertools.pairwise(bounds.tolist()):
        parts = list(zip(h1[lo:hi].tolist(), h2[lo:hi].tolist(), length[lo:hi].tolist(), strict=True))
        if len(parts) == 1:
            orders = []
            key = parts[0][:2]
        elif len(parts) <= LISTED:
            hashes = {_join(p) for p in itertools.permutations(parts)}
            key = min(hashes)
            orders = sorted(a * 2**31 + b for a, b in hashes)
        else:
            key, orders = _join(sorted(parts)), []
        bag = int(np.add.reduce(bags[lo:hi]).astype(np.int64))
        out[int(owner[lo])] = (key[0] * 2**31 + key[1], orders, bag, len(parts))
    return out


_SPLIT = re.compile(r"[=/|]|(?<![^\s_])[:—](?![^\s_])")


def _stream(text: str) -> Iterator[int]:
    for char in text:
        yield from fold_char(char)


def _equal(a: str, b: str) -> bool:
    """Two pointers over both texts, skipping and folding; stops at the first difference."""
    x, y = _stream(a), _stream(b)
    return all(p == q for p, q in itertools.zip_longest(x, y))


def _spells(parts: list[str], written: str) -> bool:
    """Whether the parts, in some order, are the written text."""
    if sum(map(len, parts)) != len(written):
        return False
    seen: set[tuple] = set()
    stack = [(0, tuple(sorted(parts)))]
    while stack:
        at, left = stack.pop()
        if not left:
            return True
        for i, part in enumerate(left):
            if (i == 0 or part != left[i - 1]) and written.startswith(part, at):
                state = (at + len(part), left[:i] + left[i + 1 :])
                if state not in seen:
                    seen.add(state)
                    stack.append(state)
    return False


def same_name(a: str, b: str) -> bool:
    """Whether two names are equal but for formatting and the order of parts."""
    a, b = (unicodedata.normalize("NFKC", decoded(x)) for x in (a, b))
    if _equal(a, b):
        return True
    # Only names whose hashes met and whose texts differ get here.
    pa, pb = ([t for x in _SPLIT.split(n) if (t := "".join(map(chr, _stream(x))))] for n in (a, b))
    if len(pa) < len(pb):
        pa, pb = pb, pa
    return _spells(pa, "".join(pb))


def canonical(name: str) -> str:
    """The canonical text of a name; built only for names whose hashes collide."""
    text = unicodedata.normalize("NFKC", decoded(name))
    parts = [p for p in ("".join(map(chr, _stream(x))) for x in _SPLIT.split(text)) if p]
    if len(parts) > LISTED:
        return "".join(sorted(parts))
    return min("".join(p) for p in itertools.permutations(parts)) if parts else ""


def with_keys(names: DataFrame, name_col: str = "name") -> DataFrame:
    """Add ``key`` (null for blank names), ``orders``, ``bag`` and ``parts`` to a table of names."""

    @F.pandas_udf("key long, orders array<long>, bag long, parts int")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = Folding()
        for names in batches:
            found = name_keys(names.where(names.notna(), None).tolist(), table)
            yield pd.DataFrame(
                {
                    "key": pd.array([x[0] if x else None for x in found], "Int64"),
                    "orders": [x[1] if x else [] for x in found],
                    "bag": pd.array([x[2] if x else None for x in found], "Int64"),
                    "parts": pd.array([x[3] if x else None for x in found], "Int32"),
                }
            )

    return names.withColumn("__k", keys(F.col(name_col))).select("*", "__k.key", "__k.orders", "__k.bag", "__k.parts").drop("__k")


def _same(a: str, b: str):
    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_name(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return same(a, b)


def groups(names: DataFrame) -> DataFrame:
    """Groups of ids whose names are equal but for formatting.

    ``names`` has tab, id, name. Returns tab, id, first_id, name, copies (rows
    of this id), for every id with a name; first_id is the least id of its group.
    """
    # Repeated rows of an id agree; they are counted before anything is hashed.
    one = names.where("id is not null").groupBy("tab", "id").agg(F.min("name").alias("name"), F.count("name").alias("copies"))
    keyed = stored(with_keys(one).where("key is not null"), "name-keys")
    # A name without separators takes the key of a parallel title that it writes out.
    titles = (
        keyed.where(F.size("orders") > 0)
        .select("tab", F.explode("orders").alias("key"), F.col("key").alias("title_key"))
        .groupBy("tab", "key")
        .agg(F.min("title_key").alias("title_key"))
    )
    # Of the names under a key the one with the most parts stands for them, as it spells all orders.
    first = stored(
        keyed.groupBy("tab", "key").agg(
            F.min("id").alias("least"), F.max_by("name", F.struct("parts", -F.col("id"))).alias("name"),
            F.any_value("bag").alias("bag"), F.max("parts").alias("parts"),
        ),
        "first-names",
    )
    # The same for titles whose orders are not listed; among several the one with the most parts.
    long = first.where(F.col("parts") > LISTED).select(
        "tab", "bag", F.col("key").alias("long_key"), F.col("name").alias("long_name"), F.col("parts").alias("long_parts")
    )
    longs = (
        first.join(long, ["tab", "bag"]).where("parts < long_parts").where(_same("name", "long_name"))
        .groupBy("tab", "key")
        .agg(F.min_by("long_key", F.struct(-F.col("long_parts"), F.col("long_key"))).alias("long_key"))
    )
    # Mostly there are no such titles, and then nothing to join.
    known = first.withColumn("long_key", F.lit(None).cast("bigint")) if long.isEmpty() else first.join(longs, ["tab", "key"], "left")
    first = known.join(titles, ["tab", "key"], "left")
    listed = F.when(F.col("parts") <= LISTED, F.col("title_key"))
    first = first.withColumn("group_key", F.coalesce("long_key", listed, "key"))
    group = first.groupBy("tab", "group_key").agg(
        F.min("least").alias("first_id"), F.max_by("name", F.struct("parts", "key")).alias("group_name")
    )
    lead = first.select("tab", "key", "group_key").join(group, ["tab", "group_key"])
    met = keyed.select("tab", "id", "name", "copies", "key").join(lead, ["tab", "key"])

    @F.pandas_udf("string")
    def clash(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if same_name(x, y) else canonical(x) for x, y in zip(a, b, strict=True)])

    # Only members that are not written exactly like the name that stands for the group need the comparison.
    same = met.where("name = group_name").withColumn("clash", F.lit(None).cast("string"))
    other = stored(met.where("name <> group_name").withColumn("clash", clash("name", "group_name")), "compared")
    every = same.unionByName(other)
    # Different names under one hash: groups of their own, found for the groups that have any.
    hit = stored(other.where("clash is not null").select("tab", "group_key").distinct(), "collided")
    cols = ["tab", "id", "first_id", "name", "copies"]
    done = every.join(hit, ["tab", "group_key"], "left_anti").select(cols)
    apart = every.join(hit, ["tab", "group_key"], "left_semi").drop("first_id").withColumn("clash", F.coalesce("clash", F.lit("")))
    own = apart.groupBy("tab", "group_key", "clash").agg(F.min("id").alias("first_id"))
    return done.unionByName(apart.join(own, ["tab", "group_key", "clash"]).select(cols))


def both_tables(topics: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The names of topics and of catalogue ids as one table of tab, id, name."""
    return topics.select(F.lit("topics").alias("tab"), F.col("topic_id").alias("id"), F.col("title").alias("name")).unionByName(
        catalogue.select(
            F.lit("catalogue").alias("tab"),
            F.col("unified.id").alias("id"),
            F.col("unified.canonical_name").alias("name"),
        )
    )


def members(names: DataFrame) -> DataFrame:
    """Each id but the least of its group, with the least as ``first_id``."""
    return groups(names).where("id <> first_id").select("tab", "first_id", F.col("id").alias("member_id"))


def collapsed(names: DataFrame) -> DataFrame:
    """One record per name: tab, first_id, n_ids and n_rows."""
    return groups(names).groupBy("tab", "first_id").agg(F.count(F.lit(1)).alias("n_ids"), F.sum("copies").alias("n_rows"))
