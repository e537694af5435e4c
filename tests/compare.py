"""Compare a registered query with its SQL text on DuckDB: names, types, rows and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _canonical(arrow):
    names = sorted(arrow.column_names)
    columns = [arrow.column(n).to_pylist() for n in names]
    data = [tuple(_plain(v) for v in row) for row in zip(*columns)]
    return names, sorted(data, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(df, sql: str, db) -> list[str]:
    """Empty when both sides agree exactly."""
    left = df.toArrow()
    right = db.sql(sql).to_arrow_table() if hasattr(db.sql(sql), "to_arrow_table") else db.sql(sql).arrow().read_all()
    names_l, rows_l = _canonical(left)
    names_r, rows_r = _canonical(right)
    if names_l != names_r:
        return [f"columns {names_l} != {names_r}"]
    out = []
    for n in names_l:
        a, b = str(left.schema.field(n).type).replace("large_", ""), str(right.schema.field(n).type).replace("large_", "")
        if a != b and not (a.startswith("list") and b.startswith("list")) and not (a.startswith("timestamp") and b.startswith("timestamp")):
            out.append(f"type of {n}: {a} != {b}")
    if len(rows_l) != len(rows_r):
        return [*out, f"rows {len(rows_l)} != {len(rows_r)}"]
    bad = [(x, y) for x, y in zip(rows_l, rows_r) if x != y]
    if bad:
        out.append(f"{len(bad)} of {len(rows_l)} rows differ, first {bad[0][0]} != {bad[0][1]}")
    return out
