"""Run a query on Spark and its SQL on DuckDB over the same tables, and compare rows regardless of order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if the DataFrame and the SQL agree, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(names, got.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; first {a[1][:2]} {b[1][:2]}"
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(bad)} of {len(a[1])} rows; first {bad[0]}" if bad else ""
