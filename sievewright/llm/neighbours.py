"""Approximate nearest neighbours by cosine: stable projections in a kd-tree, with a chi-square stop.

Unit vectors are projected on DIMS Gaussian directions. The Gaussian is 2-stable: a pair's
squared projected distance over its squared distance follows a chi-square distribution with DIMS degrees
of freedom. So once the next projected distance exceeds d_k * sqrt(quantile(CONFIDENCE)), with d_k the
k-th distance found so far, an unseen point beats d_k with probability 1 - CONFIDENCE at
most, and the search stops.

1. Equal vectors become one point that keeps its k + 1 smallest identifiers; no query can need more.
2. The upper levels of the kd-tree are fitted on a sample (SAMPLE points whose vectors hash lowest) and
   shipped; every point is indexed: it falls into a cell. A cell of more than CELL_ROWS points is
   dealt into blocks.
3. Each query searches its own cell, which gives a first d_k; it then visits exactly the cells that the
   stopping radius reaches. In a cell or block the lower levels of the tree are built, leaves are taken by
   their projected distance, and points are verified on the original vectors in double precision (times powers of two, so
   that very large and very small components keep their cosines).
4. Neighbouring cells share a unit of work (one in UNITS of all points, at least CELL_ROWS, else at most UNIT_BYTES of vectors); a
   block is a unit of its own. A point is sent once to its unit, a query once to each unit with cells to visit. A task keeps the
   points of one unit and compares a leaf with up to TOGETHER queries by one matrix product, so a unit takes any number of queries.
   Boxes of cells are compared with CELL_QUERIES queries at a time.

Vectors that are null, empty, zero, hold null or non-finite components, or have not the most frequent
length take no part, nor do rows with a null id. A row with a query's own id is never its
neighbour. Repeated rows count once. Ties go to the smaller id. An empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sievewright.llm.common import SLICE_BYTES, low_keys
from sievewright.session import settled

DIMS, CONFIDENCE = 8, 0.95
SAMPLE, SAMPLE_LEAF = 16_384, 32
CELL_ROWS, CELL_QUERIES, LEAF = 4096, 512, 32
UNITS, UNIT_BYTES, TOGETHER = 64, 16 << 20, 2048


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for an even number of degrees of freedom."""
    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, their largest component between 1/2 and 1: no square over- or underflows and no cosine changes."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


class Tree:
    """kd-tree over points: split planes, and for each leaf its box and the rows in it."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.axis, self.plane, self.child = [], [], []
        self.low, self.high, self.rows = [], [], []
        wide = np.full(points.shape[1], np.inf)
        self.root = self._grow(points, np.arange(len(points)), -wide, wide, leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points, rows, low, high, leaf) -> int:
        """Number of a node; leaves are -1 - leaf."""
        spread = np.ptp(points[rows], axis=0) if len(rows) > leaf else np.zeros(1)
        axis = int(spread.argmax())
        plane = float(np.median(points[rows, axis])) if len(rows) > leaf else 0.0
        right = points[rows, axis] > plane if len(rows) > leaf else np.zeros(0, bool)
        if len(rows) <= leaf or not spread[axis] or right.all() or not right.any():
            self.low.append(low)
            self.high.append(high)
            self.rows.append(rows)
            return -len(self.rows)
        node = len(self.axis)
        self.axis.append(axis)
        self.plane.append(plane)
        self.child.append(None)
        cut_high, cut_low = high.copy(), low.copy()
        cut_high[axis] = cut_low[axis] = plane
        self.child[node] = (self._grow(points, rows[~right], low, cut_high, leaf), self._grow(points, rows[right], cut_low, high, leaf))
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        found = np.empty(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                found[rows] = -node - 1
            elif len(rows):
                right = points[rows, self.axis[node]] > self.plane[node]
                todo += [(self.child[node][0], rows[~right]), (self.child[node][1], rows[right])]
        return found

    def reach(self, points: np.ndarray) -> np.ndarray:
        """Squared projected distance to each leaf's box (row) from each point (column)."""
        found = np.zeros((len(self.low), len(points)))
        for axis, place in enumerate(points.T):
            found += np.maximum(0, np.maximum(self.low[:, axis, None] - place, place - self.high[:, axis, None])) ** 2
        return found


class Vectors:
    """Vectors of one kind as matrices: as they are, their lengths, scaled to length one, and projected."""

    def __init__(self, column: pa.Array, projection: np.ndarray):
        self.raw = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
        self.length = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.unit = unit(self.raw)
        self.place = self.unit @ projection


def first_of(k: int, query: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best rows of each query by score, then identifier, without repeated ones; sorted by query."""
    order = np.lexsort((vec_id, -score, query))
    query, vec_id, score = query[order], vec_id[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (np.diff(query) != 0) | (np.diff(vec_id) != 0) | (np.diff(score) != 0)
    query, vec_id, score = query[new], vec_id[new], score[new]
    few = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[few], vec_id[few], score[few]


class Cell:
    """The points of one cell or block, their identifiers and the lower levels of the tree."""

    def __init__(self, rows: pa.RecordBatch, projection: np.ndarray):
        self.points = Vectors(rows.column("vector"), projection)
        self.tree = Tree(self.points.place, LEAF)
        ids = rows.column("ids")
        self.ids, self.count = ids.flatten().to_numpy(), ids.value_lengths().to_numpy()
        self.start = np.cumsum(self.count) - self.count

    def verify(self, queries: Vectors, query: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, identifier, score) for pairs of a query and a point, one row for each identifier of the point."""
        step = SLICE_BYTES // queries.raw.itemsize // queries.raw.shape[1] + 1
        product = [(self.points.raw[point[i:i + step]] * queries.raw[query[i:i + step]]).sum(axis=1) for i in range(0, len(point), step)]
        score = np.concatenate([np.zeros(0), *product]) / (self.points.length[point] * queries.length[query])
        count = self.count[point]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(query, count), self.ids[np.repeat(self.start[point], count) + place], np.repeat(score, count)

    def search(self, queries: Vectors, query_id: np.ndarray, asking: np.ndarray, bound: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, ...]:
        """(query, identifier, score): the k best for each query in `asking`, or fewer if the stop or the bound says that no more can help.

        Leaves come in rounds of 2, 4, 8, ... by their projected distance. In a round a leaf is compared with all queries
        that it is due for; only points within the stop whose score may be among the k best are verified.
        """
        reach = self.tree.reach(queries.place[asking])
        rank = np.empty(reach.shape, np.int64)
        np.put_along_axis(rank, np.argsort(reach, axis=0, kind="stable"), np.arange(len(reach))[:, None], axis=0)
        far = bound.copy()                                                   # squared k-th distances known so far
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, take = 0, 2
        while at < len(reach):
            due = (rank >= at) & (rank < at + take) & (reach <= far[asking] * limit)
            if not due.any():
                break
            at, take = at + take, take * 2
            floor = 1 - far / 2 - 1e-9
            found = []
            for leaf in np.flatnonzero(due.any(axis=1)):
                rows, mine = self.tree.rows[leaf], asking[due[leaf]]
                pairs = np.flatnonzero(self.points.unit[rows] @ queries.unit[mine].T >= floor[mine])
                found.append((mine[pairs % len(mine)], rows[pairs // len(mine)]))
            query, point = map(np.concatenate, zip(*found))
            near = ((self.points.place[point] - queries.place[query]) ** 2).sum(axis=1) <= far[query] * limit
            found = self.verify(queries, query[near], point[near])
            query, vec_id, score = map(np.concatenate, zip(best, found))
            other = vec_id != query_id[query]
            best = first_of(k, query[other], vec_id[other], score[other])
            kth = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
            far[best[0][kth]] = np.minimum(far[best[0][kth]], np.maximum(0, 2 - 2 * best[2][kth]) + 1e-12)
        return best


def units_of(sizes: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """First unit and number of units of each cell: neighbouring cells share a unit, one of more than CELL_ROWS points has a unit a block."""
    most = max(CELL_ROWS, min(sum(sizes) // UNITS, UNIT_BYTES // (8 * width)))
    first, blocks = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    last, room = 0, most
    for cell, size in enumerate(sizes):
        if size > CELL_ROWS or size > room:
            blocks[cell] = -(-size // CELL_ROWS)
            first[cell], last = last + 1, last + blocks[cell]
            room = most if blocks[cell] == 1 else 0
        else:
            first[cell] = last
        room -= size
    return first, blocks


def cells_of(points: list[pa.RecordBatch], projection: np.ndarray) -> dict[int, Cell]:
    """The cells of one unit that hold points."""
    if not points:
        return {}
    rows = pa.Table.from_batches(points).combine_chunks().to_batches()[0]
    number = rows.column("cells").flatten().to_numpy()
    return {c: Cell(rows.take(pa.array(np.flatnonzero(number == c))), projection) for c in np.unique(number).tolist()}


def search_unit(cells: dict[int, Cell], asked: pa.RecordBatch, projection: np.ndarray, k: int, limit: float) -> pa.RecordBatch:
    """The k best of one unit for each query, from the cells that it visits."""
    queries, query_id, bound = Vectors(asked.column("vector"), projection), asked.column("query_id").to_numpy(), asked.column("bound").to_numpy()
    wanted = asked.column("cells")
    number, query = wanted.flatten().to_numpy(), np.repeat(np.arange(asked.num_rows), wanted.value_lengths().to_numpy())
    found = [cells[c].search(queries, query_id, query[number == c], bound, k, limit) for c in np.unique(number).tolist() if c in cells]
    found.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
    query, vec_id, score = first_of(k, *map(np.concatenate, zip(*found)))
    return pa.RecordBatch.from_arrays([pa.array(query_id[query]), pa.array(vec_id), pa.array(score)], names=["query_id", "vec_id", "score"])


def runs(batches):
    """(unit, rows) for every run of rows of one unit in a record batch."""
    for batch in batches:
        unit_of = batch.column("unit").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(unit_of)) + 1).tolist(), len(unit_of)]
        for start, end in itertools.pairwise(cuts):
            if start < end:
                yield unit_of[start], batch.slice(start, end - start)


def slices(batch: pa.RecordBatch, most: int):
    for start in range(0, batch.num_rows, most):
        yield batch.slice(start, most)


def sound_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, vector) of rows that take part if their length does; vectors as arrays of doubles."""
    least, most, infinite = F.array_min("vector"), F.array_max("vector"), F.lit(float("inf"))
    whole = ~F.array_contains("vector", float("nan"))       # NaN is the largest double; the answer is null if a component is
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & whole & (least > -infinite) & (most < infinite) & ((least < 0) | (most > 0)))


def distinct_points(rows: DataFrame, most: int) -> DataFrame:
    """(key, vector, ids): each vector once, with a hash and the `most` smallest identifiers that have it.

    Rows are sorted by the hash first, and one shuffle serves the limit, the list and the choice of a row.
    """
    alike = Window.partitionBy("key", "vector").orderBy("vec_id")
    few = rows.withColumn("key", F.xxhash64("vector")).withColumn("n", F.dense_rank().over(alike)).where(F.col("n") <= most)
    ids = F.sort_array(F.collect_set("vec_id").over(alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return few.withColumn("ids", ids).withColumn("n", F.row_number().over(alike)).where(F.col("n") == 1).select("key", "vector", "ids")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k nearest other rows."""
    spark = vectors.sparkSession
    rows = sound_vectors(vectors, id_col, vector)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    usual = F.size("vector") == (sizes[0]["n"] if sizes else 0)
    points = settled(distinct_points(rows.where(usual), k + 1), "distinct")
    few = points.select("vector", "key").where(low_keys(F.col("key"), SAMPLE, points.count()))
    sample = few.orderBy("key", "vector").limit(SAMPLE).toPandas()
    schema = "query_id long, rank int, vec_id long, score double"
    if sample.empty:
        return spark.createDataFrame([], schema)
    fit = np.array(sample["vector"].tolist(), float)
    projection = np.random.default_rng(41).normal(size=(fit.shape[1], DIMS))
    tree = Tree(unit(fit) @ projection, SAMPLE_LEAF)
    tree.rows = []
    limit = chi_square_quantile(CONFIDENCE, DIMS)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                values = scaled(batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)) + 0.0       # no negative zeros
                cells = tree.leaf_of(unit(values) @ projection)
                yield pa.RecordBatch.from_arrays([pa.array(cells), batch.column(0), pa.array([v.tobytes() for v in values], pa.binary())],
                                                 names=["cell", batch.schema.names[0], "vector"])

    data = settled(points.select("ids", "vector").mapInArrow(placed, "cell long, ids array<long>, vector binary"), "points")
    wanted = sound_vectors(vectors.where(F.col(f"`{id_col}`").cast("long") % every == 0), id_col, vector).where(usual).distinct()
    asked = settled(wanted.select(F.col("vec_id").alias("query_id"), "vector").mapInArrow(placed, "cell long, query_id long, vector binary"), "queries")
    sizes = {r["cell"]: r["count"] for r in data.groupBy("cell").count().collect()}       # one row a leaf of the sample's tree
    first_unit, blocks = units_of([sizes.get(cell, 0) for cell in range(len(tree.low))], fit.shape[1])
    units = int((first_unit + blocks).max())        # tasks of a visit: its work goes by points times queries, not by the bytes of a partition
    first_of_cell, blocks_of_cell = (F.get(F.lit(n.tolist()), F.col("cell").cast("int")) for n in (first_unit, blocks))
    held = data.select(
        (first_of_cell + F.pmod(F.xxhash64("vector"), blocks_of_cell)).cast("long").alias("unit"), F.lit(None).cast("long").alias("query_id"), "vector",
        F.lit(None).cast("double").alias("bound"), F.array("cell").alias("cells"), "ids")

    def visit(queries: DataFrame, home: bool) -> DataFrame:
        """Search each query's own cell, or the others that its bound reaches: `queries` has (cell, query_id, vector, bound)."""
        def sent(batches):
            """A row for each unit in which the query visits cells."""
            for batch in (part for batch in batches for part in slices(batch, CELL_QUERIES)):
                visited = np.arange(len(tree.low))[:, None] == batch.column("cell").to_numpy()
                if not home:
                    reach = tree.reach(Vectors(batch.column("vector"), projection).place)
                    visited = ~visited & (reach <= batch.column("bound").to_numpy() * limit)
                query, cell = np.nonzero(visited.T)
                count = blocks[cell]
                block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                query, cell = np.repeat(query, count), np.repeat(cell, count)
                unit_of = first_unit[cell] + block
                new = np.flatnonzero(np.diff(query, prepend=-1) | np.diff(unit_of, prepend=-1))
                rows = batch.select(["query_id", "vector", "bound"]).take(pa.array(query[new]))
                cells = pa.ListArray.from_arrays(pa.array(np.append(new, len(cell)), pa.int32()), pa.array(cell))
                yield pa.RecordBatch.from_arrays([pa.array(unit_of[new]), *rows.columns, cells], names=["unit", *rows.schema.names, "cells"])

        def search(batches):
            """Points of a unit come first, for their query is null."""
            for _, group in itertools.groupby(runs(batches), key=lambda run: run[0]):
                points, cells = [], None
                for _, rows in group:
                    n = rows.column("query_id").null_count
                    points += [rows.slice(0, n)] if n else []
                    for asked in slices(rows.slice(n), TOGETHER):
                        cells = cells_of(points, projection) if cells is None else cells
                        yield search_unit(cells, asked, projection, k, limit)

        asked_of = queries.mapInArrow(sent, "unit long, query_id long, vector binary, bound double, cells array<long>")
        together = held.unionByName(asked_of.withColumn("ids", F.lit(None).cast("array<long>")))
        return together.repartition(units, "unit").sortWithinPartitions("unit", F.col("query_id").asc_nulls_first()).mapInArrow(
            search, "query_id long, vec_id long, score double")

    far = float(4.0)        # squared distances of unit vectors are at most 4
    first = settled(visit(asked.withColumn("bound", F.lit(far)), True), "first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Rows that are the same share a rank, so they become one after the window and need no shuffle of their own.
    best = first.withColumn("n", F.dense_rank().over(order)).where(F.col("n") == k).select(
        "query_id", (F.greatest(F.lit(0.0), 2 - 2 * F.col("score")) + 1e-12).alias("bound")).distinct()
    bounded = asked.join(best, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(far)))
    return first.unionByName(visit(bounded, False)).withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score").distinct()
