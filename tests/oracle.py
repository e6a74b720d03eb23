"""Runs a query and its SQL twin and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def rows_of(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(repr(tuple(_plain(r[i]) for i in order)) for r in found.fetchall())
