"""Comparing a query with its SQL twin, column by column and row by row."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(directory):
        path = f"{directory}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(repr(tuple(plain(r[k]) for k in order)) for r in rows)


def same(df, con, sql: str) -> None:
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, out.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
