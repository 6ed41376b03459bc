"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievewright.session import settled


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).toDF("a", "b").where("a <> b").distinct()


def _print_of(edges: DataFrame) -> tuple:
    """Count and two order-free sums that tell one set of links from another."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; `root` is the smallest node of its component.

    `edges` has two columns of one orderable type. A node's links are only
    aggregated and joined, never gathered. Each round is written to the shared
    folder; their number grows with the logarithm of the longest chain.
    """
    now = settled(edges.toDF("a", "b").where("a <> b").distinct(), "links")
    before = None
    while (state := _print_of(now)) != before:
        before = state
        now = settled(_small_star(settled(_large_star(now), "links")), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
