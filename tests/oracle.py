"""Spark rows against the rows of the SQL that should give the same, run by DuckDB."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb


def sql_rows(sql: str, sf: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if isinstance(x, dt.datetime):
        return x.isoformat()
    return x


def same(df, sql: str, sf: str) -> tuple[int, list]:
    """Rows of the DataFrame, and up to six rows that only one side has."""
    names, rows = sql_rows(sql, sf)
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(names)
    a = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    b = Counter(tuple(plain(r[i]) for i in at) for r in rows)
    return sum(a.values()), [("spark", x) for x in list((a - b).elements())[:3]] + [("sql", x) for x in list((b - a).elements())[:3]]
