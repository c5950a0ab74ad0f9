"""Filling containers of fixed capacity with texts, as fully as possible.

Texts are measured in tokens once, next to where they are read; from then on
only their numbers travel. They are spread over blocks of bounded size by
hash, and each block is packed on its own by conflict-constrained best fit:
texts from the longest to the shortest, bins ordered by the room they have
left. The search starts at the tightest bin with enough room and moves on to
the next until one is compatible. Every bin carries a bitmap of the sources
and one of the duplicate clusters that are in it.

Conflicts
---------
* Copies of one text do not share a container, unless a block has more copies
  than containers: then each takes an even share of them.
* One source fills at most ``source_share`` of a container with several texts.
  Texts without a source do not conflict by source.

Defined cases
-------------
* a text longer than the container is divided: whole containers first, the rest
  is packed like any other text; no other text is divided;
* an empty text has no tokens and takes no room, but is assigned; a null text is
  no text and is not assigned, nor is one whose doc_id is null;
* repeated rows are packed as rows of their own; capacities that are null or
  below one are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_ROWS = 8_000
SOURCE_SHARE = 0.5

# Fixed value: how this public vocabulary's tokenizer cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a vocabulary file of ranks; loaded once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def measured(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens and a duplicate cluster's hash, for every text."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) for t in texts], dtype="int64")

    letters = F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}\p{N}]+", "")
    return documents.where("text is not null").select(
        "doc_id",
        "source",
        F.xxhash64(letters).alias("cluster"),
        tokens("text").alias("tokens"),
    )


def pack(items: list[tuple[int, int, str | None, int]], capacity: int, source_share: float = SOURCE_SHARE) -> list[tuple]:
    """Best fit of one block: (doc_id, tokens, source, cluster) to (bin, doc_id, piece, start, tokens).

    Items longer than the capacity are cut into whole containers and a rest.
    """
    out: list[tuple[int, int, int, int, int]] = []
    rests: list[tuple[int, int, int, int, str | None, int]] = []
    bins = 0
    for doc, size, source, cluster in items:
        whole = size // capacity if size > capacity else 0
        for piece in range(whole):
            out.append((bins, doc, piece, piece * capacity, capacity))
            bins += 1
        if size - whole * capacity > 0 or not whole:
            rests.append((size - whole * capacity, doc, whole, whole * capacity, source, cluster))
    rests.sort(key=lambda r: (-r[0], r[1], r[2]))
    least_bins = max(1, -(-sum(r[0] for r in rests) // capacity))
    allowed = {c: -(-n // least_bins) for c, n in Counter(r[5] for r in rests).items() if n > 1}
    cluster_bit = {c: 1 << i for i, c in enumerate(allowed)}
    source_bit = {s: 1 << i for i, s in enumerate(sorted({r[4] for r in rests if r[4] is not None}))}
    most = int(capacity * source_share)

    room: list[tuple[int, int]] = []  # (room left, bin), ordered
    in_sources: dict[int, int] = {}  # bin to the bitmap of its sources
    in_clusters: dict[int, int] = {}  # bin to the bitmap of its duplicate clusters
    by_source: dict[tuple[int, int], int] = {}
    copies: Counter = Counter()
    for size, doc, piece, start, source, cluster in rests:
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(room, (size, -1))
        while at < len(room):
            left, b = room[at]
            clash = (
                in_clusters[b] & c and copies[b, c] >= allowed[cluster]
                or in_sources[b] & s and by_source[b, s] + size > most
            )
            if not clash:
                del room[at]
                break
            at += 1
        else:
            left, b = capacity, bins
            bins += 1
            in_sources[b] = in_clusters[b] = 0
        if left > size:
            insort(room, (left - size, b))
        in_sources[b] |= s
        in_clusters[b] |= c
        if s:
            by_source[b, s] = by_source.get((b, s), 0) + size
        if c:
            copies[b, c] += 1
        out.append((b, doc, piece, start, size))
    return out


def containers(
    documents: DataFrame,
    capacities: DataFrame,
    path: str = TOKENIZER,
    block_rows: int = BLOCK_ROWS,
    source_share: float = SOURCE_SHARE,
) -> DataFrame:
    """Every text's containers of each size.

    Returns capacity_id, container_id (unique within a capacity), doc_id,
    piece, start and tokens. Blocks hold about ``block_rows`` texts whatever
    the size of the table, so at most one container in each is left part full
    for want of texts.
    """
    sizes = capacities.where("capacity_tokens >= 1 and capacity_id is not null").select("capacity_id", "capacity_tokens").distinct()
    wanted = [(r[0], r[1]) for r in sizes.orderBy("capacity_id").limit(1001).collect()]
    if len(wanted) > 1000:
        raise ValueError("more than 1000 container sizes")
    blocks = max(1, -(-documents.count() // block_rows))
    schema = "capacity_id int, container_id long, doc_id long, piece int, start long, tokens long"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        items = [
            (int(d), int(t), None if pd.isna(s) else s, int(c))
            for d, t, s, c in zip(pdf["doc_id"], pdf["tokens"], pdf["source"], pdf["cluster"], strict=True)
        ]
        rows = [
            (cid, block * 2**32 + b, doc, piece, start, size)
            for cid, capacity in wanted
            for b, doc, piece, start, size in pack(items, capacity, source_share)
        ]
        return pd.DataFrame(rows, columns=["capacity_id", "container_id", "doc_id", "piece", "start", "tokens"])

    # Rows of one repeated id spread like any others.
    spread = F.pmod(F.xxhash64("doc_id", "tokens", "source", "cluster"), F.lit(blocks))
    if not wanted:
        return documents.sparkSession.createDataFrame([], schema)
    return (
        measured(documents, path)
        .where("doc_id is not null")
        .withColumn("block", spread)
        .groupBy("block")
        .applyInPandas(fill, schema)
    )


def fill_report(assigned: DataFrame, capacities: DataFrame) -> DataFrame:
    """For each capacity: containers, tokens and the share of room that is used."""
    per = assigned.groupBy("capacity_id").agg(
        F.countDistinct("container_id").alias("n_containers"), F.sum("tokens").alias("n_tokens")
    )
    joined = per.join(F.broadcast(capacities.select("capacity_id", "capacity_tokens").distinct()), "capacity_id")
    return joined.select(
        "capacity_id",
        "n_containers",
        "n_tokens",
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("used_share"),
    )
