"""Deterministic keys that replace seeded shuffles."""

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c) -> Column:
    return col(c).cast("string")


def hkey(id_col, seed) -> Column:
    """Uniform hexadecimal key of an id: the same order on every run and partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(text(id_col), F.lit(""))), 256)


def salted_hash(key, salt: str, length: int = 16) -> Column:
    """Leading hex digits of sha256(salt|key); a missing key hashes as the empty string."""
    return F.substring(
        F.sha2(F.concat(F.lit(f"{salt}|"), F.coalesce(text(key), F.lit(""))), 256), 1, length)
