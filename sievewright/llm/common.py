"""Helpers of the operators that run numpy inside tasks: Arrow slices, words, hashes, digests."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20       # text that one numpy step looks at; a longer single text is a step of its own

HEAVY = 1024                # a class of at least one row in so many is thinned out before it is sampled

#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches, text: str = "text", most: int = SLICE_BYTES):
    """Record batches cut so that each holds about `most` bytes of text, never cutting a text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


class Words:
    """All words of a slice of texts, as flat arrays.

    `start` and `end` are byte positions, `doc` the row of each word, `first` the
    position of each row's first word (one more entry than rows), `hash` a
    64-bit name of each word's bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        space = np.zeros(256, bool)
        space[list(SPACES)] = True
        word = ~space[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        full = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        begins[heads] = word[heads]
        ends[tails] = word[tails]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = self._hash(data, space, begins) if hashed and len(self.start) else np.zeros(len(self.start), np.uint64)

    def _hash(self, data, space, begins) -> np.ndarray:
        table = stream(11, 256)
        table[space] = 0
        place = np.arange(len(data)) - np.concatenate(([0], self.start))[np.cumsum(begins)]
        place[space[data]] = 0
        powers = np.cumprod(np.full(int((self.end - self.start).max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        place = np.minimum(place, len(powers) - 1)
        sums = np.add.reduceat(table[data] * powers[place], self.start)
        return mix(sums ^ (self.end - self.start).astype(np.uint64))

    def __len__(self):
        return len(self.start)


def grams(words: Words, n: int, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """Start word and 64-bit name of every run of n consecutive words of one text."""
    count = len(words)
    if count < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    odd = stream(seed, n) | np.uint64(1)
    name = np.zeros(count - n + 1, np.uint64)
    for j in range(n):
        name += words.hash[j:count - n + 1 + j] * odd[j]
    start = np.flatnonzero(words.doc[:count - n + 1] == words.doc[n - 1:])
    return start, mix(name[start])


def row_groups(batches, keys: int):
    """Rows of sorted record batches as tuples, grouped by their first `keys` columns, across batch borders."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    return itertools.groupby(rows, key=lambda row: row[:keys])


def in_batches(rows, names: list[str], types: list, most: int = 4096):
    """Tuples as record batches of at most `most` rows."""
    rows = iter(rows)
    while chunk := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), types)], names=names)


def numbered(df, by: list[str], order: list, out: str = "pos", size: str = "size", name: str = "numbered"):
    """`df` with the 0-based position and the number of rows of each group, written once.

    The table is range-partitioned by group and order and numbered part by part; the rows that a group
    has in earlier parts are then added. So a group may be spread over any number of tasks. Rows that
    are equal in the order must be interchangeable. Missing group values form groups of their own.
    """
    from pyspark.sql import Window, functions as F
    from sievewright.session import settled
    groups = [F.col(f"`{c}`") for c in by]
    keys = [*groups, *order]
    sorted_parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    marked = settled(sorted_parts.withColumn("__part", F.shiftright("__at", 33)), name)
    per_part = marked.groupBy("__part", *groups).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    group = Window.partitionBy(*groups) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        F.col("__part").alias("__p"), *[c.alias(f"__g{i}") for i, c in enumerate(groups)], "__first",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(group).alias(size))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(groups):
        same = same & c.eqNullSafe(F.col(f"__g{i}"))
    return marked.join(offsets, same).withColumn(out, F.col("__at") - F.col("__first") + F.col("__before")).select(
        *[F.col(f"`{c}`") for c in df.columns], out, size)


def row_key(seed: str):
    """The hash by which a row (id, text) is sampled."""
    from pyspark.sql import functions as F
    return F.xxhash64(F.lit(seed), F.col("id").cast("string"), "text")


def row_sample(df, most: int, seed: str, by: str | None = None, total: int | None = None, among=None):
    """At most `most` distinct rows (id, text), of every value of `by` if given, and at most `total` rows in all.

    `df` has the columns id and text, further ones are kept. Rows go by the hash of id and text, so repeated ids are as
    many rows as they have texts and repeated rows are one. Candidates are thinned out by
    the approximate number of distinct rows before they are ranked; only classes that hold at least 1 in
    HEAVY rows need that, of which there are at most HEAVY. No more than
    `total` hashes reach the driver. Needs values of `by` that are not null. `among` restricts the sample to the row keys in
    its column __key, so that a condition on other tables need not move texts.
    """
    from pyspark.sql import Window, functions as F
    total = total or most
    key = row_key(seed)
    group = F.col(by) if by else F.lit("")
    narrow = df.select(group.cast("string").alias("__by"), key.alias("__key")) if among is None else among.select(F.lit("").alias("__by"), "__key")
    sizes = narrow.groupBy("__by").agg(F.approx_count_distinct("__key").alias("rows"))
    whole = sizes.agg(F.sum("rows")).first()[0]
    if not whole:
        return df.limit(0)
    heavy = sizes.where(F.col("rows") * HEAVY >= whole).collect()
    rows = F.create_map(*[F.lit(x) for r in heavy for x in (r["__by"], r["rows"])])[F.col("__by")] if heavy else F.lit(None)
    few = narrow.where(rows.isNull() | low_keys(F.col("__key"), most, rows)).distinct()
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("__by").orderBy("__key"))).where(F.col("rank") <= most)
    chosen = [r["__key"] for r in ranked.orderBy("rank", "__key").limit(total).select("__key").collect()]
    found = df.withColumn("__key", key).where(F.col("__key").isin(chosen))
    others = [c for c in df.columns]
    return found.groupBy("__key").agg(*[F.min_by(c, F.struct(*[o for o in others if o not in ("id", "text")], F.lit(0))).alias(c)
                                        for c in others]).drop("__key")


def low_keys(key, wanted: int, rows):
    """Condition that leaves about twice the `wanted` lowest of `rows` uniform 64-bit keys.

    It comes before an order with a limit, of which every task would else send its own `wanted` rows.
    `rows` is a number or a column.
    """
    from pyspark.sql import functions as F
    rows = F.lit(rows) if isinstance(rows, int) else rows
    share = F.least(F.lit(1.0), F.lit(2.0 * wanted + 100) / F.greatest(rows, F.lit(1)))
    return (share >= 1) | (key.cast("double") < F.lit(-2.0 ** 63) + share * F.lit(2.0 ** 64))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
