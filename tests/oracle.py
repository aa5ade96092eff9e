"""Run catalog queries in Spark and DuckDB and compare their rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import time

import duckdb

TESTDATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def compare(df, con, sql):
    """(equal, message) of a DataFrame and a DuckDB query."""
    start = time.time()
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - start
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    duck_s = time.time() - start
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if mine == theirs:
        return True, f"{len(mine)} rows, spark {spark_s:.1f}s duckdb {duck_s:.1f}s"
    only_mine = sorted(set(mine) - set(theirs))[:2]
    only_theirs = sorted(set(theirs) - set(mine))[:2]
    return False, f"{len(mine)} vs {len(theirs)} rows; spark {only_mine} duckdb {only_theirs}"
