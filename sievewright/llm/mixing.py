"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every document falls into one of its source's blocks by the hash of its key, so a block is a
   random share. Blocks and shards are as many as the words ask for, so neither grows with the input.
2. Targets fill by weight; no source goes beyond MAX_REPEAT times its size.
3. A source gives whole passes over its blocks, then permuted blocks up to the
   rest of its target; in the block that crosses the target documents count one by
   one, and the last is taken in part (its first words). That makes an exact block quota a source.
4. The quotas are split among the output shards by a binary tree: each node
   draws how many blocks of each source go left from the multivariate
   hypergeometric distribution. A shard walks from the root to its leaf with the
   nodes' own seeds, so shards are found in parallel and again after a loss. The
   sums that went left on its way are where its disjoint range of draws begins.
5. Documents join the draws of their block; inside a shard they are ordered by
   a hash.

Only one row a source reaches the driver (`sources`, for the quota vector);
documents and blocks stay distributed. Null texts and texts without a word have
size 0 and follow their block. A null source is a source of its own, last in the
order of weights. Repeated rows are documents of their own. An empty table
gives an empty mix. Reruns agree.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from sievewright.session import settled

BLOCKS, BLOCK_WORDS = 1024, 1_000_000       # blocks a source: at least so many, and none of many more words
SHARDS, SHARD_WORDS = 64, 8_000_000         # leaves of the tree: likewise
MAX_REPEAT = 3.0
BROADCAST_SOURCES = 100_000         # tables of one row a source are broadcast up to so many sources
WEIGHTS = (5.0, 2.0, 1.0)   # repeating, by the order of the sources

_PLAIN = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as a long; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_PLAIN)), F.lit(0)).cast("long")


@F.pandas_udf(StringType())
def first_words(text: pd.Series, words: pd.Series) -> pd.Series:
    """The text up to the end of its n-th word; needed for one document a source."""
    def cut(t, n):
        for k, found in enumerate(re.finditer(_PLAIN, t or ""), 1):
            if k >= n:
                return t[:found.end()]
        return t
    return pd.Series([cut(t, n) for t, n in zip(text, words)])


def fill_targets(sizes: np.ndarray, weights: np.ndarray, share: float = 1.0, most: float = MAX_REPEAT) -> np.ndarray:
    """Share the total by weight; what a source cannot take beyond its limit goes to the others by weight."""
    total, limit = share * float(sizes.sum()), most * sizes.astype(float)
    target, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        left = total - target[~open_].sum()
        target[open_] = left * weights[open_] / weights[open_].sum()
        over = open_ & (target > limit)
        if not over.any():
            break
        target[over] = limit[over]
        open_ &= ~over
    return np.minimum(target, limit)


def split_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First draw and number of draws of each source in one shard: a walk from the root of the splitting tree."""
    start, now = np.zeros(len(quotas), np.int64), quotas.astype(np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        take = int(now.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(now, take, method="marginals") if take else np.zeros_like(now)
        if shard < middle:
            now, high = left, middle
        else:
            start, now, low = start + left, now - left, middle
    return start, now


class Mixer:
    """The plan of one mix over a table of documents."""

    def __init__(self, docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 17,
                 weights=WEIGHTS, share: float = 1.0, shards: int = SHARDS, blocks: int = BLOCKS):
        self.seed, self.spark = seed, docs.sparkSession
        place = self.place(text, id_col)
        self.docs = settled(docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"),
            place.alias("place")), "mix")
        self._plan(weights, share, shards, blocks)

    def place(self, text: str, id_col: str) -> Column:
        """The hash of a document's id and text, which decides its block and its place in it."""
        return F.xxhash64(F.lit(self.seed), F.col(f"`{id_col}`").cast("string"), F.coalesce(F.col(f"`{text}`"), F.lit("")))

    def _plan(self, weights, share, shards, blocks):
        rows = self.docs.groupBy("source").agg(F.sum("size").alias("size")).collect()
        rows.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
        self.hint = F.broadcast if len(rows) <= BROADCAST_SOURCES else lambda df: df
        sizes = np.array([r["size"] for r in rows], np.int64)
        each = np.array([weights[i % len(weights)] for i in range(len(rows))])
        target = fill_targets(sizes, each, share) if len(rows) else np.zeros(0)
        whole = np.floor(np.divide(target, sizes, out=np.zeros(len(rows)), where=sizes > 0))
        self.sources = self.spark.createDataFrame(
            pd.DataFrame({"source": [r["source"] for r in rows], "source_size": sizes, "target": target,
                          "passes": whole.astype(np.int64), "rest": target - whole * sizes,
                          "blocks": np.maximum(blocks, -(-sizes // BLOCK_WORDS))}),
            "source string, source_size long, target double, passes long, rest double, blocks long")
        self.shards = max(shards, int(-(-target.sum() // SHARD_WORDS)))
        about = self.hint(self.sources.select(F.col("source").alias("__s"), "blocks"))      # one row a source
        block = F.pmod(F.xxhash64(F.lit("block"), "place"), F.col("blocks"))
        self.blocked = self.docs.join(about, F.col("source").eqNullSafe(F.col("__s"))).withColumn("block", block).drop("__s", "blocks")
        self.per_block = settled(self.blocked.groupBy("source", "block").agg(F.sum("size").alias("words")), "mixblocks")
        self._draws()

    def _draws(self):
        """One row a draw (source, draw, block, pass, room): `room` is the words left when the block is reached."""
        blocks = self.per_block.join(self.hint(self.sources), self.per_block["source"].eqNullSafe(self.sources["source"])).select(
            self.per_block["source"], "block", "words", "passes", "rest")
        passes = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
        order = Window.partitionBy("source", "pass").orderBy(F.xxhash64(F.lit(self.seed), "source", "pass", "block"), "block")
        placed = passes.withColumns({
            "before": F.sum("words").over(order) - F.col("words"), "at": F.row_number().over(order) - 1})
        placed = placed.where((F.col("pass") < F.col("passes")) | (F.col("before") < F.col("rest")))
        sizes = self.per_block.groupBy("source").agg(F.count("*").alias("blocks")).withColumnRenamed("source", "__s")
        whole = F.col("pass") < F.col("passes")
        self.draws = settled(placed.join(self.hint(sizes), F.col("source").eqNullSafe(F.col("__s"))).select(
            "source", "block", "pass", (F.col("pass") * F.col("blocks") + F.col("at")).alias("draw"),
            F.when(~whole, F.col("rest") - F.col("before")).alias("room")), "mixdraws")

    def shard_ranges(self) -> DataFrame:
        """(shard, source, start, count): each shard finds its own leaf of the tree."""
        quotas = self.draws.groupBy("source").agg(F.count("*").alias("n")).collect()
        quotas.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        names, counts = [r["source"] for r in quotas], np.array([r["n"] for r in quotas], np.int64)
        shards, seed = self.shards, self.seed

        def leaves(batches):
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    start, count = split_quotas(counts, shards, shard, seed)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(names), pa.int64()), pa.array(names, pa.string()),
                                                      pa.array(start), pa.array(count)], names=["shard", "source", "start", "count"])
        return self.spark.range(shards).mapInArrow(leaves, "shard long, source string, start long, count long").where("count > 0")

    def taken(self) -> DataFrame:
        """(doc_id, source, size, words, place, shard, pass): one row for every time the mix takes `words` words of a document."""
        ranges = self.shard_ranges()
        dealt = ranges.withColumn("draw", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)))
        draws = self.draws.join(dealt.select(F.col("source").alias("__s"), F.col("draw").alias("__d"), "shard"),
                                F.col("source").eqNullSafe(F.col("__s")) & (F.col("draw") == F.col("__d"))).select(
            F.col("source").alias("__s"), F.col("block").alias("__b"), "pass", "room", "shard")
        same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))
        found = self.blocked.join(draws, same)
        whole = found.where("room IS NULL").withColumn("words", F.col("size"))
        # the cut block of a source: documents in hashed order, the last one in part (repeated rows share alike)
        upto = F.sum("size").over(Window.partitionBy("source", "block").orderBy("place", "doc_id"))
        rows = F.count("*").over(Window.partitionBy("source", "block", "place", "doc_id"))
        cut = found.where("room IS NOT NULL").withColumns({"upto": upto, "rows": rows}).withColumn(
            "open", F.col("room") - F.col("upto") + F.col("rows") * F.col("size")).where("open > 0").withColumn(
            "words", F.least(F.col("size"), F.floor(F.col("open") / F.col("rows")))).where("words > 0 OR size = 0").drop("upto", "rows", "open")
        return whole.unionByName(cut).select("doc_id", "source", "size", "words", "place", "shard", "pass")

    def per_document(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken), one row a document."""
        takes = self.taken().select("doc_id", "source", "place", "pass", "words").distinct().groupBy(
            F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("place").alias("__p")).agg(F.sum("words").alias("words"))
        joined = self.docs.join(takes, F.col("place").eqNullSafe(F.col("__p")) & F.col("doc_id").eqNullSafe(F.col("__d"))
                                & F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        about = self.sources.select(F.col("source").alias("__s"), "source_size", "target")
        return joined.join(self.hint(about), F.col("source").eqNullSafe(F.col("__s"))).select(
            "doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: all columns of `docs`, each row once for every time it is taken, in shards shuffled by a hash."""
    mixer = Mixer(docs, text, source, id_col, **options)
    takes = mixer.taken().groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__src"), F.col("place").alias("__place")).agg(
        F.collect_set(F.struct("shard", "pass", "words", "size")).alias("__takes"))      # at most passes + 1 entries
    joined = docs.withColumn("__key", mixer.place(text, id_col)).join(
        takes, F.col("__key").eqNullSafe(F.col("__place")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__id"))
        & F.col(f"`{source}`").cast("string").eqNullSafe(F.col("__src")))
    rows = joined.withColumn("__take", F.explode("__takes"))
    shuffled = rows.repartition(mixer.shards, F.col("__take.shard")).sortWithinPartitions(
        "__take.shard", F.xxhash64(F.lit(mixer.seed), "__key", "__take.pass"))
    # only a text that is taken in part travels to the worker
    cut = F.col("__take.words") < F.col("__take.size")
    part = F.when(cut, first_words(F.when(cut, F.col(f"`{text}`")), F.col("__take.words"))).otherwise(F.col(f"`{text}`"))
    return shuffled.withColumn(text, part).select(*[F.col(f"`{c}`") for c in docs.columns])
