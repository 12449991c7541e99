"""Runs a query and its SQL and compares the rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    con.execute("SET TimeZone='UTC'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "timestamp"):
        return value.replace(tzinfo=None).isoformat()
    return value


def differences(query, sql: str, spark, sf_dir: str) -> str:
    out = query(spark, sf_dir)
    names = sorted(out.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in out.select(*names).collect()), key=repr)
    cur = connection(sf_dir).execute(sql)
    own = [d[0] for d in cur.description]
    if sorted(own) != names:
        return f"columns {names} and {sorted(own)}"
    order = [own.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: {[x for x in zip(got, want) if x[0] != x[1]][:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}"
    return ""
