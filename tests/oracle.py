"""Compare a query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return int(v) if isinstance(v, bool) else str(v) if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, query, sql, sf_dir, con) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if len(mine) != len(theirs):
        return f"{name}: {len(mine)} and {len(theirs)} rows; {mine[:3]} {theirs[:3]}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{name}: {len(bad)} of {len(mine)} rows differ: {bad[:3]}" if bad else ""
