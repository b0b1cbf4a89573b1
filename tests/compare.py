"""Runs catalogue queries next to their SQL and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.10g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(cell(r[i])) for i in order) for r in rows)


def compare(spark, folder: str, name: str, fn, sql: str | None):
    """(ok, message)"""
    start = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"{name}: {len(got)} rows, no SQL, {took:.1f}s"
    con = duck(folder)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        a, b = [r for r in got if r not in set(want)][:4], [r for r in want if r not in set(got)][:4]
        return False, f"{name}: {len(got)} vs {len(want)} rows\n   spark {a}\n   duck  {b}"
    return True, f"{name}: {len(got)} rows equal, {took:.1f}s"
