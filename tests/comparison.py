"""Compare a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", "") for x in r))


def differences(df, c, sql: str) -> str:
    """An empty text, or what differs first."""
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    want = rows(names, got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if len(have) != len(want):
        return f"{len(have)} rows instead of {len(want)}"
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(bad)} of {len(want)} rows differ ({sorted(names)}): {bad[0][0]} instead of {bad[0][1]}" if bad else ""
