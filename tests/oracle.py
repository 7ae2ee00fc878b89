"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def connection():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def same(spark, con, query, sql) -> tuple[Counter, Counter]:
    """(rows only the query has, rows only the SQL has)."""
    df = query(spark, FOLDER)
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    got = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    return got - want, want - got
