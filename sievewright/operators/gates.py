"""Leakage checks, rule gates, hash verification and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievewright import fixed_values as fixed
from sievewright.functions import clean
from sievewright.functions.keys import col, text
from sievewright.operators.guards import once

PAIRS = [("train", "validation"), ("train", "test"), ("validation", "test")]


def _flags(split: str):
    return [F.bool_or(F.col(split) == s).alias(s) for s in fixed.SPLITS]


def _overlaps():
    return [F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in PAIRS]


def _leak(flags: DataFrame, by) -> DataFrame:
    return flags.groupBy(*by).agg(F.count("*").alias("groups"), *_overlaps())


def split_leakage(df: DataFrame, key: str, by: str = "source_dataset", split: str = "split",
                  drop_missing: bool = False) -> DataFrame:
    """Groups shared by each pair of splits, per source and pooled ('(pooled)').

    A group is reduced to three flags before anything is compared, so no set of
    ids is ever built. `drop_missing` ignores rows without a key.
    """
    if drop_missing:
        df = df.where(F.col(key).isNotNull())
    per_source = df.groupBy(F.col(by).alias("scope"), F.col(key).alias("k")).agg(*_flags(split))
    pooled = per_source.groupBy("k").agg(*[F.bool_or(s).alias(s) for s in fixed.SPLITS])
    return _leak(per_source, ["scope"]).unionByName(_leak(pooled.withColumn("scope", F.lit("(pooled)")), ["scope"]))


def multi_key_leakage(df: DataFrame, keys, split: str = "split") -> DataFrame:
    """`split_leakage` for several keys in one pass; missing keys dropped."""
    listed = F.array(*[F.struct(F.lit(k).alias("key"), text(k).alias("value")) for k in keys])
    flags = df.select(split, F.inline(listed)).where("value IS NOT NULL").groupBy("key", "value").agg(*_flags(split))
    return _leak(flags, ["key"])


def rule_gate(df: DataFrame, rules: dict) -> DataFrame:
    """Evaluate all rules of a table in one aggregate.

    A rule is `name: (aggregate column, expected)`, with one row per rule in the
    result: the observed value, whether it holds, and `frozen` iff all hold.
    """
    wanted = [str(e).lower() if isinstance(e, bool) else str(e) for _, e in rules.values()]
    observed = df.agg(*[agg.cast("string").alias(f"o{i}") for i, (agg, _) in enumerate(rules.values())])
    failed = [F.when(F.col(f"o{i}").eqNullSafe(F.lit(w)), 0).otherwise(1) for i, w in enumerate(wanted)]
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"o{i}").alias("observed"), F.lit(w).alias("expected"))
                     for i, (name, w) in enumerate(zip(rules, wanted))])
    return observed.select(sum(failed[1:], failed[0]).alias("failed"), F.inline(rows)).select(
        "rule", "observed", "expected", F.col("observed").eqNullSafe(F.col("expected")).alias("ok"),
        (F.col("failed") == 0).alias("frozen"))


def surplus(column) -> Column:
    """Aggregate: rows beyond the first of each value, NULLs being one value."""
    c = col(column)
    return F.count("*") - F.countDistinct(c) - F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def equals_set(column, allowed) -> Column:
    """Aggregate: the column takes exactly the allowed values."""
    c = text(column)
    every = F.count_if(~F.coalesce(c.isin([str(a) for a in allowed]), F.lit(False))) == 0
    for a in allowed:
        every = every & F.coalesce(F.bool_or(c == str(a)), F.lit(False))
    return every


def value_set_equals(df: DataFrame, expectations: dict) -> DataFrame:
    """One row per column: distinct values and whether they are exactly the allowed ones."""
    columns = list(expectations)
    found = df.agg(*[equals_set(c, a).alias(f"ok{i}") for i, (c, a) in enumerate(expectations.items())],
                   *[F.countDistinct(text(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    return found.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("distinct_values"), F.col(f"ok{i}").alias("uniform"))
        for i, c in enumerate(columns)])))


def conditional_rules(df: DataFrame, label: str = "label") -> DataFrame:
    """Fake rows start at 0 and have an end, real rows have neither, no row has time labels."""
    fake, real = F.col(label) == "fake", F.col(label) == "real"
    start, end = clean.number("fake_start"), clean.number("fake_end")
    blank = F.trim(F.coalesce(text("fake_start"), F.lit(""))).eqNullSafe(F.lit("")) & \
        F.trim(F.coalesce(text("fake_end"), F.lit(""))).eqNullSafe(F.lit(""))
    whole = F.coalesce(start == 0, F.lit(False)) & end.isNotNull()
    flag = F.lower(F.coalesce(text("has_timestamp_labels"), F.lit(""))) == "true"
    return df.agg(F.count_if(fake & ~whole).alias("fake_without_span"),
                  F.count_if(real & ~blank).alias("real_with_span"),
                  F.count_if(flag).alias("rows_with_time_labels"))


# ---- content hashes ----

def _line(identifier, content) -> Column:
    return F.concat(text(identifier), F.lit(":"), F.coalesce(text(content), F.lit("")), F.lit("\n"))


def _digest(pairs) -> Column:
    """sha256 over the lines of an array of (id, hash), in tuple order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(pairs), lambda p: _line(p["id"], p["h"])), ""), 256)


def fingerprint(df: DataFrame, identifier: str, content: str, digits: int = 5) -> DataFrame:
    """One digest of a whole (id, hash) collection, independent of row order.

    Equal pairs are counted first. A line is `length of id:id:hash:count`, the length `-` for a
    missing id, and falls into one of 16^digits leaves by the hash of id and content, so missing and
    repeated ids spread. A leaf digest covers its sorted lines, a branch digest the leaves that
    share their first two digits, the root the branches; no task holds more than one
    leaf or branch. `digits` is part of the definition: 5 serves up to about 10^12 rows.
    """
    name = text(identifier)
    line = F.concat_ws(":", F.coalesce(F.length(name).cast("string"), F.lit("-")), F.coalesce(name, F.lit("")),
                       F.coalesce(text(content), F.lit("")))
    lines = df.groupBy(line.alias("id")).agg(F.count("*").alias("n"))
    pair = F.struct("id", F.col("n").cast("string").alias("h"))

    def fold(level: DataFrame, keep: int) -> DataFrame:
        named = F.struct(F.col("node").alias("id"), F.col("digest").alias("h"))
        return level.groupBy(F.substring("node", 1, keep).alias("node")).agg(
            F.sum("rows").alias("rows"), _digest(F.collect_list(named)).alias("digest"))

    leaves = lines.groupBy(F.substring(F.sha2("id", 256), 1, digits).alias("node")).agg(
        F.sum("n").alias("rows"), _digest(F.collect_list(pair)).alias("digest"))
    root = F.struct(F.col("node").alias("id"), F.col("digest").alias("h"))
    return fold(leaves, 2).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                               _digest(F.collect_list(root)).alias("fingerprint"))


def verify_hashes(df: DataFrame, inventory: DataFrame, identifier: str = "sample_id", path: str = "path",
                  content: str = "sha256") -> DataFrame:
    """State of every row: missing, zero_byte, mismatch or verified."""
    actual = once(inventory.select(F.col("path").alias(path), F.col("length").alias("__len"), F.col("sha256").alias("__sha")), path)
    joined = df.join(actual, path, "left")
    stored = F.coalesce(text(content), F.lit(""))
    state = (F.when(F.col("__len").isNull(), "missing").when(F.col("__len") == 0, "zero_byte")
             .when((stored != "") & (stored != F.col("__sha")), "mismatch").otherwise("verified"))
    return joined.select(identifier, state.alias("state"), F.col("__sha").alias("actual_sha256"))


def verification_summary(verified: DataFrame) -> DataFrame:
    read = F.col("state").isin("verified", "mismatch")
    return verified.agg(F.count("*").alias("files"), F.count_if(read).alias("verified"),
                        F.count_if(F.col("state") == "missing").alias("missing"),
                        F.count_if(F.col("state") == "zero_byte").alias("zero_byte"),
                        F.count_if(F.col("state") == "mismatch").alias("hash_mismatches"))


def verified_fingerprint(verified: DataFrame, identifier: str = "sample_id") -> DataFrame:
    """The fingerprint of what was read and found unchanged."""
    return fingerprint(verified.where("state = 'verified'"), identifier, "actual_sha256")


def mismatch_examples(verified: DataFrame, identifier: str = "sample_id", n: int = 10) -> DataFrame:
    """The first n rows by id whose content changed, for a report."""
    return verified.where("state = 'mismatch'").orderBy(identifier).limit(n)


def artifact_hashes(inventory: DataFrame, listed: DataFrame, by=()) -> DataFrame:
    """sha256 and size of the listed files that exist, once each.

    Where a path alone names no file, `by` lists the columns of both tables that tell the files of a path apart.
    """
    found = listed.select("path", *by).distinct().join(inventory.select("path", *by, "length", "sha256"), ["path", *by])
    return found.select("path", "length", "sha256").distinct()
