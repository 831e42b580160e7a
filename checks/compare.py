"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from .views import TABLES

KINDS = {"bigint": "int", "int": "int", "string": "text", "double": "float", "boolean": "bool"}
DUCK_KINDS = {"BIGINT": "int", "INTEGER": "int", "VARCHAR": "text", "DOUBLE": "float", "BOOLEAN": "bool"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6) + 0.0
    return value


def compare(spark: SparkSession, folder: str, key: str, query, sql: str | None, con=None) -> str:
    """Empty text if both agree, else what differs."""
    started = time.time()
    df = query(spark, folder)
    rows = df.collect()
    spent = time.time() - started
    if sql is None:
        return "" if df.columns else "no columns"
    con = con or connect(folder)
    started = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    print(f"  {key}: {len(rows)} rows, spark {spent:.2f}s, oracle {time.time() - started:.2f}s")
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    duck = {d[0]: DUCK_KINDS.get(str(d[1]).upper(), str(d[1])) for d in cursor.description}
    wrong = {c: (kinds[c], duck[c]) for c in names if kinds[c] != duck[c]}
    if wrong:
        return f"types differ: {wrong}"
    ours = Counter(tuple(_norm(r[c]) for c in names) for r in rows)
    theirs = Counter(tuple(_norm(v) for v in r) for r in expected)
    if ours == theirs:
        return ""
    extra, missing = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
    return f"{len(rows)} rows against {len(expected)}; only spark {extra}; only sql {missing}"
