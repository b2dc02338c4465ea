"""Compares the rows of a Spark query with those of its DuckDB oracle."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    left = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    at = [found.columns.index(n) for n in names]
    right = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert left == right
