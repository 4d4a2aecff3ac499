"""Compares queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def plain(x):
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


def compare(spark, db, sf: str, query, sql: str) -> tuple[bool, int, int]:
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = db.sql(sql)
    want = rows_of(found.columns, found.fetchall())
    return got == want, len(got[1]), len(want[1])
