"""Run a registered query and its oracle, and compare them value by value."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v.is_integer() and abs(v) < 1e15 else float(f"{v:.10g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=repr)


def compare(spark_df, con, sql):
    """None when equal, else a short description of the difference."""
    return compare_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()], con, sql)


def compare_rows(columns, rows, con, sql):
    s_cols, s_rows = rows_of(columns, rows)
    cur = con.execute(sql)
    d_cols, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    if s_cols != d_cols:
        return f"columns {s_cols} != {d_cols}"
    if len(s_rows) != len(d_rows):
        extra = [r for r in s_rows if r not in set(d_rows)][:1], [r for r in d_rows if r not in set(s_rows)][:1]
        return f"rows {len(s_rows)} != {len(d_rows)}; e.g. {str(extra)[:600]}"
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(s_rows)} rows differ; {s_cols}; first {str(bad[0])[:900]}"
    if not s_rows:
        return "EMPTY"
    return None
