"""Is a published table still what a fresh build gives? A stored digest tree confines the comparison to the leaves that differ.

A row's leaf is the leading hex digits of its id's sha256. A leaf's digest is made of the number of its rows and of sums of their
digests (four 60-bit parts), so it needs no order, is aggregated before the shuffle, and no leaf is gathered.
A node is a shorter prefix and digests its children. Trees of equal tables are equal; where they differ, the descent from
the root visits children of differing nodes only, and rows are compared in differing leaves alone. The published rows are partitioned by leaf,
so other leaves are not even read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from sievewright.functions.keys import text
from sievewright.operators.joins import check_current
from sievewright.session import settled

LEAF = "__leaf"


def leaf_of(identifier: str, digits: int) -> Column:
    """Missing ids share the leaf of the empty text."""
    return F.substring(F.sha2(F.coalesce(text(identifier), F.lit("")), 256), 1, digits)


def digest_tree(df: DataFrame, identifier: str, digits: int = 3) -> DataFrame:
    """(level, node, digest) of all levels; a level is the length of its prefixes."""
    columns = sorted(c for c in df.columns if c != LEAF)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(F.col("__row"), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    leaves = df.select(leaf_of(identifier, digits).alias("node"), row.alias("__row")).groupBy("node").agg(
        F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])
    level = settled(leaves.select(F.lit(digits).alias("level"), "node", F.sha2(F.concat_ws(":", "n", "s0", "s1", "s2", "s3"), 256).alias("digest")), "leaves")
    tree = level
    for length in range(digits - 1, -1, -1):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws(":", c["node"], c["digest"])), "\n")
        level = level.groupBy(F.substring("node", 1, length).alias("node")).agg(F.sha2(children, 256).alias("digest")) \
            .select(F.lit(length).alias("level"), "node", "digest")
        tree = tree.unionByName(level)
    return tree


def publish(df: DataFrame, identifier: str, path: str, digits: int = 3) -> None:
    """Write the rows, partitioned by leaf, their tree, and their columns (an empty table has no leaf folders)."""
    df.limit(0).write.parquet(f"{path}/columns")
    df.withColumn(LEAF, leaf_of(identifier, digits)).repartition(LEAF).write.partitionBy(LEAF).parquet(f"{path}/rows")
    digest_tree(df, identifier, digits).write.parquet(f"{path}/tree")


def published_rows(spark: SparkSession, path: str, leaves: list[str] | None = None) -> DataFrame:
    """The published rows, of some leaves if given; partitions of other leaves are not read."""
    columns = spark.read.parquet(f"{path}/columns").schema
    rows = spark.read.schema(StructType([*columns.fields]).add(LEAF, StringType())).parquet(f"{path}/rows")     # leaves such as 012 are no numbers
    return rows if leaves is None else rows.where(F.col(LEAF).isin(leaves))


def differing_leaves(ours: DataFrame, theirs: DataFrame, digits: int) -> list[str]:
    """Leaves that differ between two trees, level by level from the root. At most 16^digits short texts reach the driver."""
    suspects = [""]
    for level in range(digits + 1):
        mine, other = (t.where((F.col("level") == level) & F.substring("node", 1, max(0, level - 1)).isin(suspects)).select(F.col("node"), F.col("digest").alias(n))
                       for t, n in ((ours, "a"), (theirs, "b")))
        suspects = [r["node"] for r in mine.join(other, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect()]
        if not suspects:
            return []
    return sorted(suspects)


def check_stored(fresh: DataFrame, identifier: str, path: str, digits: int = 3) -> DataFrame:
    """(missing, out_of_date, current) as `check_current` gives them, comparing rows of differing leaves only."""
    spark = fresh.sparkSession
    ours = settled(digest_tree(fresh, identifier, digits), "tree")
    leaves = differing_leaves(ours, spark.read.parquet(f"{path}/tree"), digits)
    new = fresh.where(leaf_of(identifier, digits).isin(leaves))
    return check_current(new, published_rows(spark, path, leaves).drop(LEAF))
