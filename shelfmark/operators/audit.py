"""Audits of wide records and of running work: which leaves are filled, how far a run is."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where each phase of an analysis begins and how much of the whole it is, in per cent.
PHASES = {"left": (0, 20), "right": (20, 70), "match": (90, 10)}


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """All fields of nested structs that are no structs themselves, with their types."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaves(f.dataType, path + ".") if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def filled_leaves(rows: DataFrame, used: Collection[str] = ()) -> DataFrame:
    """How many rows fill each leaf that is not in ``used``: path, n_rows.

    Null, empty arrays, empty strings and a lone dash are not filled. All
    leaves are counted in one pass.
    """
    wanted = [(p, t) for p, t in leaves(rows.schema) if p not in used]
    counts = []
    for i, (path, kind) in enumerate(wanted):
        value = F.col(path)
        there = value.isNotNull()
        if isinstance(kind, T.ArrayType | T.MapType):
            there = there & (F.size(value) > 0)
        elif isinstance(kind, T.StringType):
            there = there & (value != "") & (value != "—")
        counts.append(F.count_if(there).alias(f"n{i}"))
    if not wanted:
        return rows.sparkSession.createDataFrame([], "path string, n_rows bigint")
    one = rows.agg(*counts)
    pairs = F.array(*(F.struct(F.lit(p).alias("path"), F.col(f"n{i}").alias("n_rows")) for i, (p, _) in enumerate(wanted)))
    return one.select(F.explode(pairs).alias("x")).select("x.path", "x.n_rows")


def progress_percent(phase: Column, current: Column, total: Column) -> Column:
    """How far an analysis is over all its phases, in per cent; 0 where nothing is known."""
    out = F.lit(0.0)
    for name, (base, weight) in PHASES.items():
        out = F.when(phase == name, F.lit(float(base)) + current / total * weight).otherwise(out)
    return F.when(total == 0, 0.0).otherwise(F.round(out, 1))


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds that are left at the rate so far; null before anything is done."""
    return F.when((done > 0) & (elapsed > 0), F.ceil((total - done) * elapsed / done))
