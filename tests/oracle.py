"""Runs a query on Spark and its SQL on DuckDB and compares columns, row counts and values."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return ("n", float(v))
    if isinstance(v, int | float):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return ("n", float(f"{v:.12g}") if isinstance(v, float) else v)
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, bytearray | bytes):
        return bytes(v)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def fetch_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = [str(d[1]) for d in cur.description]
    return names, kinds, cur.fetchall()


def compare(spark, name, fn, sql, sf_dir) -> str | None:
    """None when both agree, otherwise what differs."""
    names, kinds, want = fetch_duck(duck(sf_dir), sql)
    df = fn(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = df.collect()
    order = sorted(names)
    idx = {n: i for i, n in enumerate(names)}
    a = Counter(tuple(norm(r[c]) for c in order) for r in got)
    b = Counter(tuple(norm(r[idx[c]]) for c in order) for r in want)
    if len(got) != len(want):
        only = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"rows {len(got)} != {len(want)}; spark only {str(only[0])[:900]}; sql only {str(only[1])[:900]}"
    if a != b:
        return f"values differ ({sum((a - b).values())}): spark only {str(list((a - b).items())[:3])[:1200]}; sql only {str(list((b - a).items())[:3])[:1200]}"
    kinds_spark = dict(df.dtypes)
    simple = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}
    odd = [(c, kinds_spark[c], kinds[idx[c]]) for c in order if simple.get(kinds[idx[c]]) != kinds_spark[c]]
    if odd and not all(k[1].startswith(("array", "decimal")) for k in odd):
        return f"types {odd}"
    return None if got else "no rows"
