"""Registered queries: every operator bound to the driver's tables, with its SQL check."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` under a name, optionally with the equivalent SQL."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load() -> None:
    from catalog import (audits, cleaning, gating, joining, jobs, sampling, signals, sources,  # noqa: F401
                         splitting, streams)
