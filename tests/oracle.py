"""Runs a query and its SQL on the same tables and compares the rows."""

import datetime
import glob
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.5f}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def difference(spark, con, query, sql, sf_dir):
    """None, or what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"{len(got)} and {len(want)} rows; only here {a}; only in SQL {b}"
    return None if got else "no rows"
