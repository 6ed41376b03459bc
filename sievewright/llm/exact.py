"""Exact de-duplication: sorted digest runs merged in binomial rounds. DataFrame functions only.

Every text is normalised (A-Z become a-z, nothing else), digested, and assigned to
one of RUNS runs. A run holds one row a digest: how many rows it stands for and
which identifier stays. In each round runs exchange with their partners: FAN_IN runs
with neighbouring numbers become one, merging equal digests, until a single run
is left. It stays partitioned by digest throughout, so no task sees a whole run, and
equal rows were folded before the first exchange. Rows merge only if digest, length
and a second, independent hash agree at that level; texts that share a digest but
not these stay apart.

Null counts as the empty text. With equal identifiers (repeated rows, or null) all
rows that carry the staying identifier are kept. An empty table gives no rows;
further columns are ignored. `keep` = "largest" or "smallest" decides who stays;
a null identifier stays only if its group has no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievewright.session import settled

RUNS, FAN_IN = 64, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

VERIFIED = ["text_sha256", "length", "second"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_sha256, length, second, run): what a row sends instead of its text."""
    normal = docs.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(F.col(f"`{text}`").cast("string")).alias("normal"))
    return normal.select(
        "doc_id", F.sha2("normal", 256).alias("text_sha256"), F.octet_length("normal").alias("length"),
        F.xxhash64("normal").alias("second"), F.pmod(F.xxhash64(F.lit("run"), "doc_id"), F.lit(RUNS)).cast("int").alias("run"))


def merge_runs(runs: DataFrame, keep: str = "largest") -> DataFrame:
    """All runs as one: (text_sha256, length, second, keep_id, group_size)."""
    stays = F.max if keep == "largest" else F.min
    level, left = runs, RUNS
    while True:
        # every run of this level, sorted by digest, with equal neighbours folded
        level = level.groupBy("run", *VERIFIED).agg(stays("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        if left == 1:
            return level.drop("run")
        level = level.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int"))
        left = -(-left // FAN_IN)


def _grouped(docs: DataFrame, text: str, id_col: str, keep: str) -> DataFrame:
    found = settled(digests(docs, text, id_col), "digests")
    runs = found.select("run", *VERIFIED, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    merged = merge_runs(runs, keep)
    return found.join(merged, VERIFIED).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: str = "largest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row a document.

    A large group meets its merged row in a join that adaptive execution can split.
    """
    return _grouped(docs, text, id_col, keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: str = "largest") -> DataFrame:
    """The rows of `docs` that stay; a row goes by its id and text, so other texts of its id stay."""
    gone = _grouped(docs, text, id_col, keep).where(~F.col("kept")).select(
        F.col("doc_id").alias("__gone"), *[F.col(c).alias(f"__{c}") for c in VERIFIED]).distinct()
    normal = normalised(F.col(f"`{text}`").cast("string"))
    own = [F.sha2(normal, 256), F.octet_length(normal), F.xxhash64(normal)]
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__gone"))
    for name, value in zip(VERIFIED, own):
        same = same & (value == F.col(f"__{name}"))
    return docs.join(gone, same, "left_anti")
