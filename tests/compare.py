"""Run a query and its SQL twin and compare them, as the correctness gate does."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) and math.isfinite(v):
        return 0.0 if v == 0 else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if v is not None and type(v).__name__ == "Decimal":
        return _value(float(v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(diff)} of {len(got[1])} rows differ, e.g. {diff[0]}" if diff else ""
