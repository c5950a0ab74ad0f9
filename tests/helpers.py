"""Comparing a query's rows with those of its SQL."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(value):
    return repr(round(value, 6) if isinstance(value, float) else value)


def rows_of(df, columns):
    return sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())


def sql_rows(con, sql, columns):
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == columns, (sorted(names), columns)
    at = [names.index(c) for c in columns]
    return sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
