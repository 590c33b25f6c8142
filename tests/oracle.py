"""Runs a registered query on Spark and its oracle SQL on DuckDB, and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def tables(sf: str):
    con = duckdb.connect()
    con.execute("set threads to 2")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return v


def same(spark_rows, spark_columns, duck_rows, duck_columns) -> str:
    """Empty if both hold the same rows; else what differs."""
    if sorted(spark_columns) != sorted(duck_columns):
        return f"columns {sorted(spark_columns)} and {sorted(duck_columns)}"
    order = sorted(spark_columns)
    left = sorted((tuple(plain(r[spark_columns.index(c)]) for c in order) for r in spark_rows), key=str)
    right = sorted((tuple(plain(r[duck_columns.index(c)]) for c in order) for r in duck_rows), key=str)
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    for a, b in zip(left, right, strict=True):
        for x, y in zip(a, b, strict=True):
            if x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))):
                return f"{order}: {a} and {b}"
    return ""
