"""Exact ranks, running totals and quantiles that survive hot groups.

`row_number() OVER (PARTITION BY g)` puts a group into one task, and one group
may hold a third of all rows. Rows are therefore counted first (one job over the
group columns when the plan is built), and every group is cut into cells whose
borders respect the order, as many as the rows ask for: positions are counted inside
a cell, and the sizes of the cells before it are added. Where one cell holds the largest
group there is nothing to add, and the plain window is what is left of the plan. The
table of cell sizes is small, so the only large shuffle is by `(group, cell)`. Tests run the queries
with cells of a few rows as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievewright.functions.clean import number
from sievewright.functions.keys import col

CELL_ROWS = 1_000_000       # rows of a group one task may sort; session setting sievewright.cell.rows
KEYS_PER_CELL = 16          # sampled order keys behind each border
GROUP_LIMIT = 100           # up to this k every task may send its first k rows of a group

_GROUP, _CELL, _KEY, _BORDERS = "__group", "__cell", "__key", "__borders"


def _group_struct(by) -> Column:
    """Group columns as one struct, so that a NULL key equals itself in the join."""
    return F.struct(*[col(b).alias(f"g{i}") for i, b in enumerate(by)]) if by else F.lit(0)


def _cell_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("sievewright.cell.rows", str(CELL_ROWS)))


def _extent(df: DataFrame, by) -> tuple[int, int]:
    """Rows of the largest group, and of all groups."""
    if not by:
        rows = df.count()
        return rows, rows
    found = df.groupBy(*[col(b) for b in by]).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return found[0], found[1]


def _borders(df: DataFrame, order, rows: int, cells: int) -> Column:
    """Sorted array of cell borders, a lazy scalar.

    Keys are sampled by their hash, so every evaluation yields the same borders,
    and duplicates collapse, so the array stays near KEYS_PER_CELL * cells keys.
    """
    keys = df.select(F.struct(*order).alias(_KEY))
    share = max(1, rows // (cells * KEYS_PER_CELL))
    chosen = keys.where(F.pmod(F.xxhash64(_KEY), F.lit(share)) == 0)
    ordered = chosen.agg(F.array_sort(F.collect_set(_KEY)).alias("k"))
    return ordered.select(F.filter("k", lambda _, i: i % KEYS_PER_CELL == KEYS_PER_CELL - 1).alias("b")).scalar()


def _with_cells(df: DataFrame, by, order, largest: int, rows: int, hashed: bool, keys_from: DataFrame) -> DataFrame:
    """Add the group as a struct and the cell.

    Of a hash the leading digits are the cell, as many as the largest group needs.
    Otherwise the cell is the number of borders up to the key. The binary search is one
    projection per step, which Spark compiles; a higher-order function would be
    interpreted and is ten times slower.
    """
    order = [col(o) for o in order]
    grouped = df.withColumn(_GROUP, _group_struct(by))
    if hashed:
        digits = 2
        while 16 ** digits * _cell_rows(df) < largest:
            digits += 1
        return grouped.withColumn(_CELL, F.substring(order[0], 1, digits))
    cells = max(1, rows // _cell_rows(df))
    found = grouped.withColumns({_BORDERS: _borders(keys_from, order, rows, cells), _KEY: F.struct(*order), _CELL: F.lit(0)})
    for step in [1 << i for i in reversed(range((2 * cells).bit_length()))]:
        reached = F.get(_BORDERS, F.col(_CELL) + (step - 1)) <= F.col(_KEY)
        found = found.withColumn(_CELL, F.when(reached, F.col(_CELL) + step).otherwise(F.col(_CELL)))
    return found.drop(_BORDERS, _KEY)


def running_sums(df: DataFrame, by, order, sums: dict[str, Column], hashed: bool = False,
                 keys_from: DataFrame | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """Add inclusive running totals per group in the given ascending, total order.

    `hashed` says that the first order column is a uniform hexadecimal key, whose
    leading digits then serve as cells, without borders.
    Groups are measured, and borders sampled, on `keys_from`: a cheaper
    frame with the same group and order columns and at least the rows of `df`.
    `totals` names columns for the group totals, `{new column: name in sums}`.
    """
    by, order, totals = list(by), list(order), totals or {}
    others = [F.col(f"`{c}`") for c in df.columns if c not in sums]
    ordered = [col(o) for o in order]
    upto = (Window.unboundedPreceding, 0)
    measured = keys_from or df
    largest, rows = _extent(measured, by)
    if largest <= _cell_rows(df) and (by or not hashed):       # hashes cut the whole table into cells for nothing
        group = Window.partitionBy(*[col(b) for b in by])
        plain = group.orderBy(*ordered).rowsBetween(*upto)
        return df.select(*others, *[F.coalesce(F.sum(v).over(plain), F.lit(0)).alias(n) for n, v in sums.items()],
                         *[F.sum(sums[n]).over(group).alias(t) for t, n in totals.items()])
    cells = _with_cells(df, by, order, largest, rows, hashed, measured)
    sizes = cells.groupBy(_GROUP, _CELL).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    group = Window.partitionBy(_GROUP)
    earlier = group.orderBy(_CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(_GROUP).alias("__g"), F.col(_CELL).alias("__c"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums],
        *[F.sum(n).over(group).alias(t) for t, n in totals.items()])
    inside = Window.partitionBy(_GROUP, _CELL).orderBy(*ordered).rowsBetween(*upto)
    local = cells.withColumns({f"__in_{n}": F.sum(v).over(inside) for n, v in sums.items()})
    joined = local.join(offsets, (F.col(_GROUP) == F.col("__g")) & (F.col(_CELL) == F.col("__c")))
    return joined.select(
        *others, *[(F.coalesce(F.col(f"__in_{n}"), F.lit(0)) + F.col(f"__before_{n}")).alias(n) for n in sums], *totals)


def rank(df: DataFrame, by, order, out: str = "rank", hashed: bool = False,
         keys_from: DataFrame | None = None) -> DataFrame:
    """Add the 1-based position in the group as a long."""
    return running_sums(df, by, order, {out: F.lit(1).cast("bigint")}, hashed, keys_from)


def first_per_group(df: DataFrame, by, order, k: int, out: str | None = None,
                    hashed: bool = False) -> DataFrame:
    """The first k rows of every group.

    For small k Spark keeps k rows per group and task before the shuffle
    (WindowGroupLimit), so a hot group arrives as tasks * k rows; beyond
    GROUP_LIMIT the positions come from `rank`.
    """
    name = out or "__rn"
    if k <= GROUP_LIMIT:
        window = Window.partitionBy(*[col(b) for b in by]).orderBy(*[col(o) for o in order])
        ranked = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k) \
            .withColumn(name, F.col(name).cast("bigint"))
    else:
        ranked = rank(df, by, order, name, hashed).where(F.col(name) <= k)
    return ranked if out else ranked.drop(name)


def exact_quantiles(df: DataFrame, by, value, probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per group: equal to `percentile`, without a group in one buffer.

    Values are counted first, so the order statistics are read off the running
    counts of distinct values. Also returns `n`, the number of values
    (NaN is none).
    """
    by = list(by)
    keys = [f"k{i}" for i in range(len(by))]
    named = df.select(*[col(b).alias(k) for b, k in zip(by, keys)], number(value).alias("v")) \
        .where("v IS NOT NULL")
    counts = named.groupBy(*keys, "v").agg(F.count("*").alias("w"))
    placed = running_sums(counts, keys, ["v"], {"upto": F.col("w")}, keys_from=named, totals={"n": "upto"})
    after, before = F.col("upto"), F.col("upto") - F.col("w")
    aggs = [F.max("n").alias("n")]
    for i, p in enumerate(probs.values()):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        for end, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((before <= at) & (at < after), F.col("v"))).alias(f"{end}{i}"))
    picked = placed.groupBy(*keys).agg(*aggs)
    names = [b if isinstance(b, str) else f"key{i}" for i, b in enumerate(by)]
    result = []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        result.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "n", *result)
