"""Stored results of runs: one folder a run, resumed part by part, kept or dropped; and cached tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, at: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _done(spark: SparkSession, at: str) -> bool:
    """Whether a table was written to its end."""
    fs, p = _path(spark, f"{at}/_SUCCESS")
    return fs.exists(p)


def save(spark: SparkSession, folder: str, run: str, parts: Mapping[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Write the parts of a run in their order and return them as tables.

    A part that was written to its end before is not made again, so a run that
    was broken off goes on with the first part that is missing. A part is made
    only when its turn comes and may read the parts before it.
    """
    for name, make in parts.items():
        at = f"{folder}/{run}/{name}"
        if not _done(spark, at):
            make().write.mode("overwrite").parquet(at)
    return {name: spark.read.parquet(f"{folder}/{run}/{name}") for name in parts}


def load(spark: SparkSession, folder: str, run: str, name: str) -> DataFrame:
    """A part of a stored run."""
    return spark.read.parquet(f"{folder}/{run}/{name}")


def names(spark: SparkSession, folder: str) -> list[str]:
    """The stored runs by name."""
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def keep_only(spark: SparkSession, folder: str, keep: str | None = None) -> list[str]:
    """Delete all runs but one, or all of them; returns the deleted ones."""
    gone = [n for n in names(spark, folder) if n != keep]
    for n in gone:
        fs, p = _path(spark, f"{folder}/{n}")
        fs.delete(p, True)
    return gone


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], seconds: float = 1800.0) -> DataFrame:
    """A table that is made again only once its stored copy is older than ``seconds``.

    A new copy gets a folder of its own and older ones go after it is written,
    so a reader never meets half a table.
    """
    at = f"{folder}/{key}"
    fs, p = _path(spark, at)
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(p)] if fs.exists(p) else []
    ready = [(t, path) for t, path in found if _done(spark, path)]
    if ready and max(ready)[0] / 1000.0 >= time.time() - seconds:
        return spark.read.parquet(max(ready)[1])
    new = f"{at}/{uuid.uuid4().hex}"
    make().write.parquet(new)
    for _, path in found:
        fs.delete(_path(spark, path)[1], True)
    return spark.read.parquet(new)
