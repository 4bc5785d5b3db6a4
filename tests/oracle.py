"""Spark's rows held against DuckDB's, as multisets over columns sorted by name."""

from __future__ import annotations

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def rows_of_sql(sql: str, folder: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
