"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

EXACT = bool(os.environ.get("CHECK_EXACT"))     # compare doubles bit by bit
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def kind(value):
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    return type(value).__name__


def plain(value):
    if value is None:
        return ("none", None)
    if isinstance(value, decimal.Decimal):
        return ("decimal", float(value))
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else value if EXACT else float(f"{value:.9g}"))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(plain(v) for v in value))
    return (kind(value), value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def difference(con, df, sql: str) -> str | None:
    """None when equal, else what differs."""
    left_cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    right_cols, right = rows_of([d[0] for d in found.description], found.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} / {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}; only here {list(set(left) - set(right))[:2]}, only there {list(set(right) - set(left))[:2]}"
    for a, b in zip(left, right):
        if a != b:
            extra = sorted(set(left) - set(right), key=repr)[:2], sorted(set(right) - set(left), key=repr)[:2]
            return f"values {extra[0]}\n   /   {extra[1]} in {left_cols}"
    if not left:
        return "EMPTY"
    return None
