"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(columns: list[str], data: list) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=lambda r: tuple((x is not None, str(x)) for x in r))


def differences(df, sql: str, connection) -> str | None:
    """None if names, number and values of rows agree."""
    r = connection.execute(sql)
    names, want = [x[0] for x in r.description], r.fetchall()
    got = [tuple(x) for x in df.collect()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows, not {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y and not all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 for p, q in zip(x, y))]
    return f"{len(bad)} of {len(a)} rows, such as {bad[0]}"[:600] if bad else None
