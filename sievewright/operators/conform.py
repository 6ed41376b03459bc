"""Projection to common schemas, lookups, filters, ids, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.types import StringType

from sievewright import fixed_values as fixed
from sievewright.functions import clean
from sievewright.functions.keys import col, text
from sievewright.operators.guards import once
from sievewright.operators.running import rank


def align_source(df: DataFrame, mapping: dict, origin: str | None = None) -> DataFrame:
    """Project to target names; a mapped column that does not exist becomes NULL."""
    columns = [(F.col(src) if src in df.columns else F.lit(None).cast("string")).alias(target)
               for target, src in mapping.items()]
    if origin is not None:
        columns.append(F.lit(origin).alias("origin_metadata_file"))
    return df.select(*columns)


def unify_entity_id(df: DataFrame) -> DataFrame:
    """`speaker_id` is the target speaker where that column exists, else the plain one, else NULL."""
    missing = F.lit(None).cast("string")
    if "target_speaker_id" in df.columns:
        source = text("source_speaker_id") if "source_speaker_id" in df.columns else missing
        return df.withColumns({"speaker_id": text("target_speaker_id"),
                               "target_speaker_id": text("target_speaker_id"),
                               "source_speaker_id": source})
    speaker = text("speaker_id") if "speaker_id" in df.columns else missing
    return df.withColumns({"speaker_id": speaker, "target_speaker_id": missing,
                           "source_speaker_id": missing})


def select_existing(df: DataFrame, order) -> DataFrame:
    return df.select(*[c for c in order if c in df.columns])


def attach_lookup(df: DataFrame, key: str, table: DataFrame, defaults: dict) -> DataFrame:
    """Left join on `key`; unmatched keys take the defaults, a repeated key is an error. Columns named in `defaults` are replaced."""
    looked = once(table.select(key, *[F.col(c).alias(f"__{c}") for c in defaults]), key)
    kept = df.drop(*[c for c in defaults if c in df.columns])
    joined = kept.join(looked, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.lit(d)) for c, d in defaults.items()}) \
        .drop(*[f"__{c}" for c in defaults])


def _usable(not_null, value, lo, hi):
    usable = F.coalesce(col(value).between(lo, hi), F.lit(False))
    for c in not_null:
        usable = usable & col(c).isNotNull()
    return usable


def usable_filter(df: DataFrame, not_null, value: str, lo, hi,
                  observation: Observation | None = None) -> DataFrame:
    """Complete rows inside an inclusive range; the dropped count goes to the observation."""
    usable = _usable(not_null, value, lo, hi)
    if observation is not None:
        df = df.observe(observation, F.count_if(~usable).alias("dropped"))
    return df.where(usable)


def usable_counts(df: DataFrame, not_null, value: str, lo, hi, by=()) -> DataFrame:
    usable = _usable(not_null, value, lo, hi)
    return df.groupBy(*by).agg(F.count_if(usable).alias("usable"), F.count_if(~usable).alias("dropped"))


def exclude_upstream(df: DataFrame, label: str, sources, label_col: str = "label",
                     source_col: str = "upstream_dataset") -> DataFrame:
    """Drop the named sources within one label; exact equality only."""
    hit = (F.col(label_col) == label) & F.col(source_col).isin(list(sources))
    return df.where(~F.coalesce(hit, F.lit(False)))


def availability(df: DataFrame, quota: int, by=()) -> DataFrame:
    """Rows against the quota, per group."""
    return df.groupBy(*by).agg(F.count("*").alias("available")).select(
        *by, "available", F.lit(quota).cast("bigint").alias("quota"), (F.col("available") >= quota).alias("enough"))


def min_available(df: DataFrame, quota: int) -> DataFrame:
    """The input itself, or an error when it holds fewer rows than the quota."""
    found = availability(df, quota).first()
    if not found.enough:
        raise ValueError(f"only {found.available} usable rows, {quota} needed")
    return df


def format_ids(df: DataFrame, prefix: str, order, by=(), width: int = 5, out: str = "sample_id",
               hashed: bool = False) -> DataFrame:
    """Zero-padded position in the order, counted from 0 inside each group."""
    ranked = rank(df, by, order, "__pos", hashed)
    return ranked.withColumn(out, F.format_string(f"{prefix}%0{width}d", F.col("__pos") - 1)).drop("__pos")


# ---- publishing ----

def _published(df: DataFrame, id_col, path_col, group_col, salt, columns: dict) -> DataFrame:
    return df.select(
        col(id_col).alias("sample_id"),
        *[c.alias(name) for name, c in columns.items()],
        clean.salted_hash(group_col, salt).alias("group_id"),
        clean.relativize_path(path_col).alias("path"))


def _no_null(name):
    return F.coalesce(text(name), F.lit(""))


def redact_master(df: DataFrame, salt: str) -> DataFrame:
    """Publishable projection of the master; audio facts describe the canonical file."""
    return _published(df, "sample_id", "processed_file_path", "group_id", salt, {
        "label": F.col("label"), "language_type": F.col("language_type"),
        "source_dataset": F.col("source_dataset"), "generator": _no_null("generator"),
        "split": F.col("split"), "duration": F.col("processed_duration"),
        "codec": F.col("processed_codec"), "sha256": F.col("processed_sha256")})


def redact_derived(df: DataFrame, id_col: str, salt: str) -> DataFrame:
    """Publishable projection of an augmented or robustness manifest."""
    return _published(df, id_col, "augmented_file_path", "group_id", salt, {
        "parent_sample_id": F.col("parent_sample_id"), "label": F.col("label"),
        "language_type": F.col("language_type"), "source_dataset": F.col("source_dataset"),
        "generator": _no_null("generator"), "split": F.col("split"),
        "augmentation_condition": F.col("augmentation_condition"), "duration": F.col("duration"),
        "codec": F.col("codec"), "sha256": F.col("sha256")})


def redact_external(df: DataFrame, salt: str, language_type: str,
                    inventory: DataFrame | None = None) -> DataFrame:
    """Publishable projection of the held-out set: every row is its own group.

    Hashes come from an inventory `(path, sha256)` and are '' for absent files.
    """
    base = df.withColumn("path", clean.relativize_path("file_path"))
    if inventory is None:
        base = base.withColumn("sha256", F.lit(""))
    else:
        base = attach_lookup(base, "path", inventory.select("path", "sha256"), {"sha256": ""})
    return base.select(
        "sample_id", "label", F.lit(language_type).alias("language_type"), "source_dataset",
        _no_null("source_model").alias("generator"), F.lit("evaluation").alias("split"),
        _no_null("spoof_type").alias("spoof_type"), "duration", "codec", "sha256",
        clean.salted_hash("sample_id", salt).alias("group_id"), "path")


def forbid(df: DataFrame, columns=fixed.FORBIDDEN_COLUMNS,
           pattern: str = fixed.USER_PATH_PATTERN) -> DataFrame:
    """One row per check and column with its number of violations.

    Every string column is searched for absolute user paths, every `*group_id`
    for an unhashed `::`; a forbidden column violates with all its rows.
    """
    checks = [(c, "forbidden column", F.lit(True)) for c in df.columns if c in set(columns)]
    for field in df.schema.fields:
        if isinstance(field.dataType, StringType):
            if field.name.endswith("group_id"):
                checks.append((field.name, "unhashed group", F.contains(F.col(field.name), F.lit("::"))))
            checks.append((field.name, "absolute user path", F.col(field.name).rlike(pattern)))
    counts = df.agg(*[F.count_if(hit).alias(f"c{i}") for i, (_, _, hit) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(name).alias("column_name"), F.lit(check).alias("check"),
                              F.col(f"c{i}").alias("violations"))
                     for i, (name, check, _) in enumerate(checks)])
    return counts.select(F.inline(rows))


def assert_publishable(df: DataFrame, columns=fixed.FORBIDDEN_COLUMNS) -> DataFrame:
    present = sorted(set(df.columns) & set(columns))
    if present:
        raise ValueError(f"forbidden columns: {present}")
    worst = forbid(df, columns).where("violations > 0").limit(5).collect()
    if worst:
        raise ValueError(f"not publishable: {[tuple(r) for r in worst]}")
    return df


def sample_rows(df: DataFrame, n: int, order="sample_id") -> DataFrame:
    """The first n rows by id, as examples in a report."""
    return df.orderBy(order).limit(n)


def id_sorted(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*order)
