"""Compare a query with its SQL twin on DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def assert_same(df, con, sql: str) -> None:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    twin = con.sql(sql)
    assert got == rows_of(twin.columns, twin.fetchall())
