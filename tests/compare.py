"""Spark rows against DuckDB's on the same parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def duck(sf_dir: str = SF):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*' if f.is_dir() else ''}')")
    con.execute("SET TimeZone = 'UTC'")
    return con


def difference(df, sql: str, sf_dir: str = SF) -> str:
    """Empty where the rows and column names are the same."""
    got = duck(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall())
    have = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    if want == have:
        return ""
    return f"{sum(have.values())} rows against {sum(want.values())}; only Spark {list((have - want).items())[:3]}; only SQL {list((want - have).items())[:3]}"
