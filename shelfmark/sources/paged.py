"""Data sources for catalogues that are served as JSON, page by page or by lists of ids.

``spark.read.format("paged_json")`` reads a catalogue: page 1 tells how many
pages there are, every page is one input partition, and rows carry (page, pos),
as the scan order decides winners later on. ``spark.read.format("lookup_json")``
reads the answers to lookups, and :func:`lookup` asks for a table of ids in
batches and reports failed batches as rows.

The base (``path``) is a folder, or the address of a server: an address is asked
for ``?page=N&pageSize=M``, or for ``?ids=1,2,3``. Reads are retried with a
growing pause; an answer that says ``success: false``, or another status than
2xx, fails the read at once. A reading task asks for its pages one after the
other over one connection and keeps to ``rate`` requests a second; with n tasks
at a time the server sees n times as many, so ``rate`` is the share of one.

Options: ``path``, ``retries`` (3), ``pause`` (seconds, 2), ``page_size``
(1000), ``rate`` (10 a second; 0 for no limit), ``timeout`` (seconds, 30).
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.operators.ranking import numbered


class AnswerFailed(Exception):
    """The catalogue answered that it failed; asking again would not help."""


def is_address(base: str) -> bool:
    return base.startswith(("http://", "https://"))


def _load(path: str, timeout: float) -> dict:
    """What a file or an address holds; another status than 2xx is a failed answer."""
    if not is_address(path):
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    request = urllib.request.Request(path, headers={"Accept": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return json.loads(answer.read().decode("utf-8"))
    except urllib.error.HTTPError as e:
        raise AnswerFailed(f"status {e.code}") from e


def fetch(path: str, retries: int, pause: float, timeout: float = 30.0) -> dict:
    """The parsed envelope of a page, retried with a linearly growing pause."""
    for attempt in range(1, retries + 1):
        try:
            envelope = _load(path, timeout)
        except (OSError, ValueError):
            if attempt == retries:
                raise
            time.sleep(pause * attempt)
            continue
        if not isinstance(envelope, dict) or envelope.get("success") is False:
            raise AnswerFailed(str(envelope.get("error") if isinstance(envelope, dict) else envelope)[:200])
        return envelope
    raise AssertionError("unreachable")


class Pacer:
    """Lets at most ``rate`` requests a second pass."""

    def __init__(self, rate: float):
        self.gap = 1.0 / rate if rate > 0 else 0.0
        self.next = 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def page_at(base: str, number: int, size: int) -> str:
    """Where a page is found."""
    if is_address(base):
        return f"{base}{'&' if '?' in base else '?'}{urlencode({'page': number, 'pageSize': size})}"
    return os.path.join(base, f"page-{number}.json")


def rows_of(envelope: dict) -> list:
    return (envelope.get("data") or {}).get("rows") or []


class _Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options["path"]
        self.retries = int(options.get("retries", 3))
        self.pause = float(options.get("pause", 2))
        self.size = int(options.get("page_size", 1000))
        self.rate = float(options.get("rate", 10))
        self.timeout = float(options.get("timeout", 30))

    def _page(self, number: int) -> dict:
        return fetch(page_at(self.base, number, self.size), self.retries, self.pause, self.timeout)

    def partitions(self) -> list[InputPartition]:
        data = self._page(1).get("data") or {}
        return [InputPartition(n) for n in range(1, int(data.get("totalPages", 1)) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if is_address(self.base):
            Pacer(self.rate).wait()
        for pos, row in enumerate(rows_of(self._page(partition.value))):
            yield partition.value, pos, json.dumps(row, ensure_ascii=False)


class PagedJson(DataSource):
    """Pages of a catalogue: page, pos, body."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, pos int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)


class _Lookups(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.retries = int(options.get("retries", 5))
        self.pause = float(options.get("pause", 3))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in sorted(os.listdir(self.folder)) if n.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            envelope = fetch(os.path.join(self.folder, partition.value), self.retries, self.pause)
        except (AnswerFailed, OSError, ValueError) as e:
            # A failed batch is counted and does not fail the others.
            yield partition.value, None, None, str(e)[:200]
            return
        for row in (envelope.get("data") or {}).get("rows") or []:
            unified = row.get("unified") if isinstance(row, dict) else None
            number = unified.get("id") if isinstance(unified, dict) else None
            yield partition.value, int(number) if number is not None else None, json.dumps(row, ensure_ascii=False), None


class LookupJson(DataSource):
    """Answers to batched lookups: batch, unified_id, body, error."""

    @classmethod
    def name(cls) -> str:
        return "lookup_json"

    def schema(self) -> str:
        return "batch string, unified_id bigint, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Lookups(self.options)


def lookup(
    ids: DataFrame, base: str, id_col: str = "id", batch: int = 50, retries: int = 5, pause: float = 3.0, rate: float = 10.0, timeout: float = 30.0
) -> DataFrame:
    """The catalogue's rows for a table of ids: batch, unified_id, body, error.

    The distinct ids are numbered and asked for in batches of ``batch``. A
    batch that fails gives one row with the error and the others still come; an
    id that the server does not know gives no row. ``base`` must be an address.
    """
    if not is_address(base):
        raise ValueError("lookups need an address")
    some = ids.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    placed = numbered(some, [], [F.col("id")], "place")
    lists = placed.groupBy(F.floor((F.col("place") - 1) / batch).cast("bigint").alias("batch")).agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pacer = Pacer(rate)
        for frame in batches:
            for number, wanted in zip(frame["batch"], frame["ids"], strict=True):
                pacer.wait()
                at = f"{base}{'&' if '?' in base else '?'}{urlencode({'ids': ','.join(map(str, wanted))}, safe=',')}"
                out = []
                try:
                    for row in rows_of(fetch(at, retries, pause, timeout)):
                        unified = row.get("unified") if isinstance(row, dict) else None
                        found = unified.get("id") if isinstance(unified, dict) else None
                        out.append((number, int(found) if found is not None else None, json.dumps(row, ensure_ascii=False), None))
                except (AnswerFailed, OSError, ValueError) as e:
                    out = [(number, None, None, str(e)[:200])]
                yield pd.DataFrame(out, columns=["batch", "unified_id", "body", "error"]).astype({"unified_id": "Int64"})

    return lists.mapInPandas(ask, "batch bigint, unified_id bigint, body string, error string")


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(PagedJson)
    spark.dataSource.register(LookupJson)
