"""Substring de-duplication by recompression.

Words get content names. A round names maximal runs of one symbol by (symbol, length), gives every
symbol a side by its hash, and names each left symbol followed by a right one as a pair. Names
depend on nothing but content, so every task gives equal substrings the same interior symbols
without exchanging a dictionary. A round decides at a border by the two symbols there alone, so of a window of
`window` words all symbols are certain but the first and last runs and, after pairing, a first right or a last left
one. Each window is represented by the longest of its certain symbols at the highest round that leaves it any
(ties: smallest hash). Equal windows therefore have equal representatives.

1. Spark counts the representatives over all documents. Where one occurs once, its windows
   occur once; they are settled without being compared.
2. The other windows are named by all their words (96 bits) and sorted: within a task's slice
   first, so that a passage that many documents share sends one row a slice, then over all.
   Every window but the first of its name is a copy.
3. A word under a copy is removed.

Documents are ordered by id, then by a hash of the text. Repeated rows (same id, same text) are one document
and keep what it keeps; a null id sorts first. Null and short texts lose nothing. Very long texts
are slices of their own. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sievewright.llm.common import Words, grams, mix, sha256_hex, slices, stream, text_buffers
from sievewright.operators.running import rank
from sievewright.session import settled

WINDOW_WORDS, ROUNDS = 20, 3


class Level:
    """Symbols of one round: name, text, first word and number of words."""

    def __init__(self, name, doc, start, length):
        self.name, self.doc, self.start, self.length = name, doc, start, length


def _shrink(level: Level, number: int):
    """The next round: new level, run of each old symbol, side of each run, new symbol of each run."""
    odd = stream(71, 4) | np.uint64(1)
    head = np.ones(len(level.name), bool)
    head[1:] = (level.name[1:] != level.name[:-1]) | (level.doc[1:] != level.doc[:-1])
    heads = np.flatnonzero(head)
    times = np.diff(np.append(heads, len(head)))
    name = level.name[heads]
    name = np.where(times > 1, mix(name * odd[0] + times.astype(np.uint64)), name)
    doc, start = level.doc[heads], level.start[heads]
    length = np.add.reduceat(level.length, heads)
    right = (mix(name + odd[1:2] * np.uint64(number)) >> np.uint64(63)).astype(bool)
    joined = np.zeros(len(name), bool)      # a left symbol with a right one behind it
    joined[:-1] = ~right[:-1] & right[1:] & (doc[1:] == doc[:-1])
    begins = np.ones(len(name), bool)
    begins[1:] = ~joined[:-1]
    first = np.flatnonzero(begins)
    pair = first[joined[first]]
    symbol = np.cumsum(begins) - 1
    new = name[first]
    new[symbol[pair]] = mix(name[pair] * odd[2] + name[pair + 1] * odd[3] + np.uint64(number))
    return Level(new, doc[first], start[first], np.add.reduceat(length, first)), np.cumsum(head) - 1, right, symbol


def representatives(words: Words, window: int = WINDOW_WORDS, rounds: int = ROUNDS):
    """Starts of all windows, and the name and first word of each one's representative."""
    n = len(words)
    starts = np.flatnonzero(words.doc[:n - window + 1] == words.doc[window - 1:]) if n >= window else np.zeros(0, np.int64)
    name, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    level = Level(words.hash, words.doc, np.arange(n), np.ones(n, np.int64))
    alive, a, b = np.arange(len(starts)), starts, starts + window - 1

    def settle(which, a, b, level, number):
        """Choose among the certain symbols a..b of windows that no later round can represent."""
        score = (np.minimum(level.length, 255).astype(np.uint64) << np.uint64(56)) | (mix(level.name) >> np.uint64(8))
        best, top = a.copy(), score[a]
        for j in range(1, int((b - a).max(initial=0)) + 1):
            at = np.minimum(a + j, b)
            better = score[at] > top
            best[better], top[better] = at[better], score[at[better]]
        name[which] = mix(level.name[best] + np.uint64(number))
        place[which] = level.start[best]

    for number in range(1, rounds + 1):
        if not len(alive):
            break
        after, run, right, symbol = _shrink(level, number)
        low, high = run[a] + 1, run[b] - 1
        good = low <= high
        low, high = np.minimum(low, len(right) - 1), np.maximum(high, 0)
        low, high = low + right[low], high - ~right[high]
        good &= low <= high
        settle(alive[~good], a[~good], b[~good], level, number - 1)
        alive, a, b, level = alive[good], symbol[low[good]], symbol[high[good]], after
    if len(alive):
        settle(alive, a, b, level, rounds)
    return starts, name, place


def numbered(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(uid, doc_id, text): uid orders documents by id and is unique but for repeated rows."""
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ids = named.select(F.col("doc_id").cast("long").alias("uid")).groupBy("uid").agg(F.count("*").alias("n"))
    if not ids.where("n > 1 OR uid IS NULL").isEmpty():
        key = F.xxhash64(F.coalesce("text", F.lit("")))
        order = rank(settled(named.select("doc_id", key.alias("key")).distinct(), "ids"), [], ["doc_id", "key"], "uid")
        order = settled(order, "uids").select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "uid")
        return named.withColumn("key", key).join(order, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("key") == F.col("__k"))) \
            .select("uid", "doc_id", "text")
    return named.select(F.col("doc_id").cast("long").alias("uid"), "doc_id", "text")


def shared_windows(docs: DataFrame, window: int) -> DataFrame:
    """(uid, lo, n): stretches of windows whose representative occurs more than once."""
    def run(batches):
        for batch in slices(batches):
            uid = batch.column("uid").to_numpy()
            words = Words(*text_buffers(batch.column("text")))
            start, name, place = representatives(words, window)
            if not len(start):
                continue
            doc = words.doc[start]
            new = np.ones(len(start), bool)
            new[1:] = (place[1:] != place[:-1]) | (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(start)))
            name, owner, lo = name[at], uid[doc[at]], (start[at] - words.first[doc[at]]).astype(np.int32)
            # a name that the slice holds several times is sent once; the others need no company and are spread
            _, first, number, times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
            known = times[number] > 1
            spread = known & (first[number] != np.arange(len(name)))
            name[spread] = mix(owner[spread].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo[spread].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(owner), pa.array(lo), pa.array(count.astype(np.int32)), pa.array(known)],
                names=["name", "uid", "lo", "n", "known"])
    found = docs.select("uid", "text").mapInArrow(run, "name long, uid long, lo int, n int, known boolean")
    # another place with the same name stands next to it in this order
    order = Window.partitionBy("name").orderBy("uid", "lo")
    beside = F.lag("uid").over(order).isNotNull() | F.lead("uid").over(order).isNotNull()
    return found.withColumn("shared", beside).where("shared OR known").select("uid", "lo", "n")


def copied_windows(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """(uid, starts): first words of the windows that also start earlier."""
    def run(batches):
        for batch in slices(batches):
            uid, words = batch.column("uid").to_numpy(), Words(*text_buffers(batch.column("text")))
            start, name = grams(words, window)
            _, check = grams(words, window, seed=97)
            wanted = np.zeros(len(words) + 1, np.int32)
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                low = words.first[row] + np.fromiter((s["lo"] for s in spans), np.int64, len(spans))
                np.add.at(wanted, low, 1)
                np.add.at(wanted, low + np.fromiter((s["n"] for s in spans), np.int64, len(spans)), -1)
            keep = np.cumsum(wanted)[start] > 0
            start, name, check = start[keep], name[keep], (check[keep] >> np.uint64(32)).astype(np.uint32)
            doc = words.doc[start]
            lo = (start - words.first[doc]).astype(np.int32)
            order = np.lexsort((lo, uid[doc], check, name))
            start, name, check, doc, lo = start[order], name[order], check[order], doc[order], lo[order]
            new = np.ones(len(start), bool)
            new[1:] = (name[1:] != name[:-1]) | (check[1:] != check[:-1])
            first = np.flatnonzero(new)
            head = np.repeat(first, np.diff(np.append(first, len(start))))
            copy = (uid[doc] != uid[doc[head]]) | (lo != lo[head])
            # back in the order of the text, where ids and positions take little room
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            name, check, doc, lo, later = name[back], check[back], doc[back], lo[back], copy[back]
            send = ~later
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[send].view(np.int64)), pa.array(check[send].view(np.int32)), pa.array(uid[doc[send]]), pa.array(lo[send]),
                 pa.array(np.zeros(send.sum(), bool))], names=["name", "check", "uid", "lo", "later"])
            # copies within the slice are settled here and only travel to their document
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(int(later.sum()), pa.int64()), pa.nulls(int(later.sum()), pa.int32()), pa.array(uid[doc[later]]), pa.array(lo[later]),
                 pa.array(np.ones(later.sum(), bool))], names=["name", "check", "uid", "lo", "later"])
    spans = shared.groupBy("uid").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    found = settled(docs.select("uid", "text").join(spans, "uid").mapInArrow(run, "name long, check int, uid long, lo int, later boolean"), "windows")
    order = Window.partitionBy("name", "check").orderBy("uid", "lo")
    over = found.where("NOT later").withColumn("at", F.rank().over(order)).where("at > 1").select("uid", "lo")
    return over.union(found.where("later").select("uid", "lo")).groupBy("uid").agg(F.collect_list("lo").alias("starts"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW_WORDS, text: str = "text", id_col: str = "doc_id",
                     texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]), one row a document; text: kept words joined by one space.

    Without `texts` the kept words stay in the workers.
    """
    named = numbered(docs, text, id_col)
    shared = settled(shared_windows(named, window), "shared")
    copied = settled(copied_windows(named, shared, window), "copied").withColumnRenamed("uid", "__uid")
    joined = named.join(copied, F.col("uid") == F.col("__uid"), "left").select("doc_id", "text", "starts")
    def run(batches):
        for batch in slices(batches):
            count, gone, kept = [], [], []
            for words, starts in zip(batch.column("text").to_pylist(), batch.column("starts")):
                words = (words or "").encode().split()      # bytes.split() cuts at exactly the white space of the word pattern
                keep = np.ones(len(words) + 1, bool)
                if starts.is_valid:
                    edge = np.zeros(len(words) + window + 1, np.int32)
                    at = starts.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    keep = np.cumsum(edge)[:len(words) + 1] == 0
                left = [w for w, k in zip(words, keep) if k] if starts.is_valid else words
                count.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            columns = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array([sha256_hex(k) for k in kept])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([k.decode() for k in kept])] if texts else []),
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"] + (["text"] if texts else []))
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", text string" if texts else ""))
