"""Similarity join on n-gram Jaccard with Bayesian pruning of candidates.

The set of a text is its distinct runs of five consecutive words (a text of one to four
words has one run: the whole). Texts with equal sets form one class; from here on
classes stand for their documents.

1. Each set gets 128 MinHash values of 16 bits. Four neighbouring values form a band;
   classes that agree in a band are candidates. At similarity 0.8 a pair is missed
   with probability (1 - 0.8^4)^32, about 5e-8.
2. A bucket of more than BLOCK classes is cut into blocks, and every pair of blocks
   is a unit of work of its own. Inside a unit MinHash values are compared 16 at a time.
   After m matches in n values the similarity s has the posterior Beta(m + 1, n - m + 1);
   pairs with P(s >= threshold) below TOLERANCE are dropped. A pair counts only in
   the first band it agrees in, so units share no pair.
3. Survivors are verified on the exact sets, unit by unit; big units by a matrix product.
   A unit returns how many links each class has and a spanning forest of them,
   never the pairs, so rows grow with the members of a group and not with their square.
4. Links are summed and joined to components.

Null texts, texts without words and rows with a null id have no links; each is its own
class (class_id = its id). Repeated rows are copies of each other. An empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievewright.llm.common import Words, grams, mix, slices, stream, text_buffers
from sievewright.llm.links import components
from sievewright.session import settled

GRAM, THRESHOLD = 5, 0.8
VALUES, ROWS = 128, 4       # MinHash values, values a band
STEP = 16                   # values compared at a time
TOLERANCE = 1e-6
BLOCK = 512                 # classes of a bucket in one block
STRIP = 1 << 18             # pairs looked at in one numpy step
DENSE = 64                  # members from which a unit is verified by a matrix product


def gram_sets(column, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram names of every text."""
    words = Words(*text_buffers(column))
    start, name = grams(words, n)
    at = np.searchsorted(start, words.first)
    sets = [np.unique(name[a:b]) for a, b in zip(at[:-1], at[1:])]
    for row, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        if 0 < b - a < n:
            odd = stream(29, int(b - a) + 1) | np.uint64(1)
            sets[row] = mix((words.hash[a:b] * odd[1:]).sum(keepdims=True) ^ odd[:1])
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, 16 bits each, as rows of 64-bit bands."""
    flat = np.concatenate(sets)
    heads = np.cumsum([0] + [len(s) for s in sets[:-1]])
    salt, odd = stream(31, VALUES), stream(37, VALUES) | np.uint64(1)
    values = np.empty((len(sets), VALUES), np.uint16)
    for k in range(VALUES):
        values[:, k] = (mix(np.minimum.reduceat((flat ^ salt[k]) * odd[k], heads)) >> np.uint64(40)).astype(np.uint16)
    return values.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """Fewest matches after n values with which a pair goes on."""
    found = {}
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:     # P(s >= t | m of n) = P(Bin(n + 1, t) <= m) under a uniform prior
            m += 1
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        found[n] = m
    return found


def sketch(docs: DataFrame, n: int, text: str, id_col: str) -> DataFrame:
    """(doc_id, text_key, cid, size, bands): cid is a 128-bit digest of the set, null for an empty one."""
    def run(batches):
        for batch in slices(batches):
            sets = gram_sets(batch.column("text"), n)
            rows = [k for k, s in enumerate(sets) if len(s)]
            bands, cid = [None] * len(sets), [None] * len(sets)
            if rows:
                for k, signature in zip(rows, signatures([sets[k] for k in rows])):
                    bands[k], cid[k] = signature, hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(cid, pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "cid", "size", "bands"])
    kind = docs.schema[id_col].dataType.simpleString()
    return _keyed(docs, text, id_col).mapInArrow(run, f"doc_id {kind}, text_key long, cid binary, size long, bands array<long>")


def _keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    words = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(words).alias("text_key"), words.alias("text"))


def _units(batches, names):
    """Tables of whole units from batches sorted by unit."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        edge = [batch.column(c)[batch.num_rows - 1].as_py() for c in names]
        same = np.ones(batch.num_rows, bool)
        for c, v in zip(names, edge):
            same &= batch.column(c).to_numpy(zero_copy_only=False) == v
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks()
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(table, names) -> np.ndarray:
    change = np.zeros(max(0, table.num_rows - 1), bool)
    for c in names:
        v = table.column(c).to_numpy()
        change |= v[1:] != v[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [table.num_rows]))


def _pairs(bounds: np.ndarray):
    """Index pairs i < j inside each unit, in pieces of about STRIP pairs."""
    size = np.diff(bounds)
    small = np.concatenate([np.arange(a, b) for a, b in zip(bounds[:-1], bounds[1:]) if b - a <= DENSE] or [np.zeros(0, int)])
    stop = np.repeat(bounds[1:], size)
    for k in range(1, int(size[size <= DENSE].max(initial=1))):
        i = small[small + k < stop[small]]
        for a in range(0, len(i), STRIP):
            yield i[a:a + STRIP], i[a:a + STRIP] + k
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a > DENSE:
            rows = max(1, STRIP // (b - a))
            for r in range(a, b, rows):
                i, j = np.meshgrid(np.arange(r, min(b, r + rows)), np.arange(a, b), indexing="ij")
                keep = i < j
                yield i[keep], j[keep]


def surviving(table, bounds, least: dict[int, int]):
    """Pairs of each unit that Bayesian pruning leaves, in the first band they agree in."""
    bands = table.column("bands").combine_chunks()
    bands = bands.chunk(0) if isinstance(bands, pa.ChunkedArray) else bands
    bands = bands.flatten().to_numpy().reshape(table.num_rows, -1)
    values = bands.view(np.uint16)
    band, block = table.column("band").to_numpy(), table.column("block").to_numpy()
    crossed = table.column("lo").to_numpy() != table.column("hi").to_numpy()
    for i, j in _pairs(bounds):
        keep = ~crossed[i] | (block[i] != block[j])
        i, j = i[keep], j[keep]
        matches = np.zeros(len(i), np.int16)
        for n in range(STEP, VALUES + 1, STEP):
            matches += (values[i, n - STEP:n] == values[j, n - STEP:n]).sum(axis=1, dtype=np.int16)
            keep = matches >= least[n]
            i, j, matches = i[keep], j[keep], matches[keep]
        if len(i):
            agree = bands[i] == bands[j]
            keep = agree[np.arange(len(i)), band[i]] & (agree.argmax(axis=1) == band[i])
            if keep.any():
                yield i[keep], j[keep]


def _overlaps(sets, i, j) -> np.ndarray:
    """Common n-grams of each pair of rows."""
    rows = np.unique(np.concatenate((i, j)))
    if len(rows) < DENSE:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    gram, number, count = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[number] > 1
    owner, number = owner[keep], shared[number[keep]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    product = np.zeros((len(rows), len(rows)), np.float32)
    width = 4096
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [low, low + width])
        dense = np.zeros((len(rows), width), np.float32)
        dense[owner[a:b], number[a:b] - low] = 1
        product += dense @ dense.T
    return product[np.searchsorted(rows, i), np.searchsorted(rows, j)].astype(np.int64)


UNIT = ["band", "key", "lo", "hi"]


def candidates(classes: DataFrame) -> DataFrame:
    """(band, key, lo, hi, block, cid): the members of every unit of work."""
    members = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = members.join(shared, ["band", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("cid", "band"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.withColumn("other", other).select(
        "band", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cid")


def links(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
          text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The verified join: sketches of all documents, (cid, n_links), and (a, b) links that span each component."""
    least = least_matches(threshold, tolerance)
    sketches = settled(sketch(docs, n, text, id_col), "sketches")
    named = sketches.where("cid IS NOT NULL AND doc_id IS NOT NULL")
    classes = settled(named.groupBy("cid").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("bands").alias("bands"))
                      .select("cid", "rep.doc_id", "rep.text_key", "bands"), "classes")

    def prune(batches):
        for table in _units(batches, UNIT):
            found = [np.concatenate(p) for p in surviving(table, _bounds(table, UNIT), least)]
            rows = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            yield from table.select([*UNIT, "block", "cid"]).take(pa.array(rows)).combine_chunks().to_batches()

    unit_schema = "band int, key long, lo int, hi int, block int, cid binary"
    with_bands = candidates(classes).join(classes.select("cid", "bands"), "cid")
    survivors = settled(with_bands.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(prune, unit_schema), "survivors")

    def verify(batches):
        for table in _units(batches, UNIT):
            bounds = _bounds(table, UNIT)
            sets = gram_sets(table.column("text"), n)
            size = np.array([len(s) for s in sets])
            count, parent = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
            for i, j in surviving(table, bounds, least):
                unit = np.searchsorted(bounds, i, "right")
                order = np.argsort(unit, kind="stable")
                i, j = i[order], j[order]
                edges = np.flatnonzero(np.diff(unit[order])) + 1
                for i, j in zip(np.split(i, edges), np.split(j, edges)):
                    common = _overlaps(sets, i, j)
                    linked = common >= threshold * (size[i] + size[j] - common) - 1e-9
                    i, j = i[linked], j[linked]
                    np.add.at(count, i, 1)
                    np.add.at(count, j, 1)
                    _union(parent, i, j)
            rows = np.flatnonzero(count)
            root = np.array([_root(parent, r) for r in rows], np.int64)
            cid = table.column("cid").combine_chunks()
            cid = cid.chunk(0) if isinstance(cid, pa.ChunkedArray) else cid
            yield pa.RecordBatch.from_arrays([cid.take(pa.array(rows)), cid.take(pa.array(root)), pa.array(count[rows])], names=["a", "b", "n"])

    texts = _keyed(docs, text, id_col).join(
        survivors.select("cid").distinct().join(classes, "cid"), ["doc_id", "text_key"]).select("cid", "text", "bands")
    texts = texts.dropDuplicates(["cid"])
    filled = survivors.join(texts, "cid").repartition(*UNIT).sortWithinPartitions(*UNIT)
    verified = settled(filled.mapInArrow(verify, "a binary, b binary, n long"), "verified")
    return sketches, verified.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n_links")), verified.select("a", "b")


def _root(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _union(parent, i, j):
    """Join rows into trees; of many links in a dense unit most fall away at the first test."""
    for a, b in zip(i.tolist(), j.tolist()):
        if parent[a] != parent[b]:
            a, b = _root(parent, a), _root(parent, b)
            parent[max(a, b)] = min(a, b)


def keyed_groups(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                 text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: (doc_id, text_key, class_id, copy_of, copies, n_links).

    text_key: hash of the text, which tells texts of one id apart; class_id: smallest id of all
    documents reachable over links; copy_of: smallest id with the same set; copies: how many
    documents share the set; n_links: how many other sets are at least as similar as the threshold.
    """
    sketches, counts, edges = links(docs, n, threshold, tolerance, text, id_col)
    roots = settled(components(edges), "roots")
    named = sketches.where("cid IS NOT NULL AND doc_id IS NOT NULL")
    about = named.groupBy("cid").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies")) \
        .join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    first = about.where("root IS NOT NULL").groupBy("root").agg(F.min("copy_of").alias("first"))
    about = about.join(first, "root", "left").select(
        "cid", "copy_of", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "copy_of").alias("class_id"))
    grouped = named.select("doc_id", "text_key", "cid").join(about, "cid").select("doc_id", "text_key", "class_id", "copy_of", "copies", "n_links")
    alone = sketches.where("cid IS NULL OR doc_id IS NULL").select(
        "doc_id", "text_key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(1).cast("long").alias("copies"),
        F.lit(0).cast("long").alias("n_links"))
    return grouped.unionByName(alone)


def jaccard_groups(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                   text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The same without the hash of the text: (doc_id, class_id, copy_of, copies, n_links)."""
    return keyed_groups(docs, n, threshold, tolerance, text, id_col).drop("text_key")
