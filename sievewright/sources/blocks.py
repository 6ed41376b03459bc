"""Row blocks of parquet files: positions, statistics, purity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def with_block_position(df: DataFrame, block_rows: int) -> DataFrame:
    """File, block number and offset in the block; `df` must be a parquet scan."""
    return df.select(
        "*", F.col("_metadata.file_name").alias("file"),
        F.floor(F.col("_metadata.row_index") / block_rows).alias("block"),
        (F.col("_metadata.row_index") % block_rows).alias("row_in_block"))


def block_profile(positioned: DataFrame, columns) -> DataFrame:
    """Rows and the range of each column per block; a block is pure in a column whose range is one value."""
    ranges = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    profile = positioned.groupBy("file", "block").agg(F.count("*").alias("num_rows"), *ranges)
    pure = {f"pure_{c}": F.coalesce(F.col(f"{c}_min") == F.col(f"{c}_max"), F.lit(False)) for c in columns}
    return profile.withColumns(pure).withColumn("pure", reduce(lambda a, b: a & b, [F.col(p) for p in pure]))


def block_report(profile: DataFrame, group: str, entity: str) -> DataFrame:
    """Pure and impure blocks per group value, with entities and mean rows among the pure ones."""
    key = F.when(F.col(f"pure_{group}"), F.col(f"{group}_min")).otherwise(F.lit("(mixed)"))
    return profile.groupBy(key.alias(group)).agg(
        F.count("*").alias("blocks"), F.count_if("pure").alias("pure_blocks"),
        F.countDistinct(F.when(F.col("pure"), F.col(f"{entity}_min"))).alias("entities"),
        F.round(F.avg("num_rows"), 6).alias("mean_rows"))
