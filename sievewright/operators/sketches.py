"""Mergeable sketches: quantiles and distinct entities kept per part and combined later.

An exact operator has to see all rows again when a part arrives; a sketch of every part is kept instead, and sketches of parts
merge into that of the whole. Quantiles: KLL, with a rank error of about 1.33 % at k = 200 and falling as k grows; exact up to k values. Entities: theta, with a
relative error of about 1.6 % at 2^12 entries; exact below that many. Cut into `cells` by a hash of the entity, with fewer entities
in each than a sketch has entries, they are exact at any size and grow with the entities. The exact operators (`quantile_table`,
`median_by`, `entity_counts`, `shared_entities`) remain the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievewright.functions.clean import number
from sievewright.functions.keys import text

ENTRIES = 12        # log2 of the entries of a theta sketch
K = 200


def quantile_sketches(df: DataFrame, by, value: str, k: int = K) -> DataFrame:
    """(by..., sketch) of the values that are numbers."""
    named = df.select(*by, number(value).alias("__v")).where("__v IS NOT NULL")
    return named.groupBy(*by).agg(F.kll_sketch_agg_double("__v", k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by, probs: dict[str, float], k: int = K) -> DataFrame:
    """(by..., n, one column a probability) from sketches of parts."""
    whole = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return whole.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"),
                        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()])


def _named(df: DataFrame, by, entity: str) -> DataFrame:
    known = F.nullif(F.trim(text(entity)), F.lit(""))
    return df.select(*by, known.alias("__e")).where("__e IS NOT NULL")


def exact_cells(df: DataFrame, by, entity: str, entries: int = ENTRIES) -> int:
    """Cells enough for exact sketches of every group: a quarter of a sketch's entries in each, a power of two.

    A group's entities are estimated to a few percent, and the hash spreads them evenly; what is over
    nevertheless is found by `merged_entities`.
    """
    groups = _named(df, by, entity).groupBy(*by).agg(F.approx_count_distinct("__e").alias("n"))
    most = groups.agg(F.max("n").alias("n")).first()["n"] or 0
    return 1 << (-(-4 * most // 2 ** entries) - 1).bit_length() if most else 1


def entity_sketches(df: DataFrame, by, entity: str, entries: int = ENTRIES, cells: int | None = None) -> DataFrame:
    """(by..., [cell,] rows, sketch): rows with an entity, and a sketch of the distinct ones. Blank entities are none.

    With `cells` every cell has its own sketch; sketches that are merged later need the same number of cells.
    """
    named = _named(df, by, entity)
    if cells:
        named = named.withColumn("cell", F.pmod(F.xxhash64("__e"), F.lit(cells)).cast("int"))
    return named.groupBy(*by, *(["cell"] if cells else [])).agg(F.count("*").alias("rows"), F.theta_sketch_agg("__e", entries).alias("sketch"))


def _whole(sketch: str, entries: int) -> Column:
    """The entities of a cell; an error if its sketch has begun to estimate."""
    n = F.theta_sketch_estimate(sketch)
    return F.when(n <= 2 ** entries, n).otherwise(F.raise_error(F.lit("a cell holds more entities than a sketch has entries: take more cells")))


def merged_entities(sketches: DataFrame, by, entries: int = ENTRIES) -> DataFrame:
    """(by..., rows, entities) from sketches of parts; exact if they have cells."""
    if "cell" not in sketches.columns:
        return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.theta_sketch_estimate(F.theta_union_agg("sketch", entries)).alias("entities"))
    cells = sketches.groupBy(*by, "cell").agg(F.sum("rows").alias("rows"), F.theta_union_agg("sketch", entries).alias("sketch"))
    return cells.groupBy(*by).agg(F.sum("rows").alias("rows"), F.sum(_whole("sketch", entries)).alias("entities"))


def shared_estimate(sketches: DataFrame, by: str, left, right, entries: int = ENTRIES) -> DataFrame:
    """(left, right, shared): the estimated number of entities that two groups share; exact if the sketches have cells."""
    keys = ["cell"] if "cell" in sketches.columns else []
    named = sketches if keys else sketches.withColumn("cell", F.lit(1))
    sides = [named.where(F.col(by) == v).groupBy("cell").agg(F.theta_union_agg("sketch", entries).alias(n)) for v, n in ((left, "a"), (right, "b"))]
    both = sides[0].join(sides[1], "cell")
    if keys:
        both = both.where((_whole("a", entries) >= 0) & (_whole("b", entries) >= 0))
    shared = F.coalesce(F.sum(F.theta_sketch_estimate(F.theta_intersection("a", "b"))), F.lit(0.0))
    return both.agg(shared.alias("shared")).select(F.lit(left).alias("left_value"), F.lit(right).alias("right_value"), "shared")
