"""Runs queries against their check SQL on the same Parquet files."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

INTS = {"tinyint", "smallint", "int", "bigint"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(name: str) -> str:
    n = name.lower()
    if n in INTS or n in ("integer", "hugeint"):
        return {"integer": "int"}.get(n, n)
    if n in ("string", "varchar"):
        return "string"
    return n


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return repr(v)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    got = [tuple(r) for r in spark_df.collect()]
    names = spark_df.columns
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want_types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}"
    kinds = dict(spark_df.dtypes)
    for n, t in zip(want_names, want_types):
        if _kind(kinds[n]) != _kind(t):
            return f"type of {n}: {kinds[n]} != {t}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    order = sorted(names)
    gi = [names.index(n) for n in order]
    wi = [want_names.index(n) for n in order]
    a = sorted(tuple(_norm(r[i]) for i in gi) for r in got)
    b = sorted(tuple(_norm(r[i]) for i in wi) for r in want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first {order}: {bad[0][0]} != {bad[0][1]}"
    return None
