"""Reproducible sampling: round robin, caps, quotas, top-ups.

Shuffles are orders by `hkey`; the same seed gives the same rows on any cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sievewright import fixed_values as fixed
from sievewright.functions.keys import col, hkey, text
from sievewright.operators.running import first_per_group, rank, running_sums
from sievewright.session import settled

_H = "__hkey"


def _same(columns, others):
    """Null-safe equality over parallel columns."""
    cond = F.lit(True)
    for a, b in zip(columns, others):
        cond = cond & a.eqNullSafe(b)
    return cond


def seeded_order(df: DataFrame, identifier: str, seed=fixed.SEED, n: int | None = None) -> DataFrame:
    """Rows in shuffled order, optionally only the first n; these are found by rank, so n may be large."""
    if n is None:
        return df.withColumn(_H, hkey(identifier, seed)).orderBy(_H, identifier).drop(_H)
    return shuffled_rank(df, [], identifier, seed, "__rank").where(F.col("__rank") <= n).orderBy("__rank").drop("__rank")


def shuffled_rank(df: DataFrame, by, identifier: str, seed=fixed.SEED, out: str = "rank") -> DataFrame:
    """1-based position in the seeded shuffle of each group."""
    keyed = df.withColumn(_H, hkey(identifier, seed))
    return rank(keyed, by, [_H, identifier], out, hashed=True).drop(_H)


def _fill_level(sizes: DataFrame, n: int):
    """Scalar struct (level, extra): every group gives `level` rows, `extra` groups one more.

    Found on the histogram of group sizes, which has at most sqrt(2 * rows) lines.
    """
    histogram = sizes.groupBy("size").agg(F.count("*").alias("m"))
    before = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy("size").rowsBetween(0, Window.unboundedFollowing)
    steps = histogram.select(
        "size", F.coalesce(F.sum(F.col("size") * F.col("m")).over(before), F.lit(0)).alias("below"),
        F.sum("m").over(onwards).alias("open"), F.coalesce(F.max("size").over(before), F.lit(0)).alias("prev"))
    fits = steps.where((F.col("below") + F.col("prev") * F.col("open") <= n)
                       & (F.col("below") + F.col("size") * F.col("open") > n))
    spare = F.lit(n) - F.col("below")
    return fits.agg(F.max(F.struct(F.floor(spare / F.col("open")).alias("level"),
                                   (spare % F.col("open")).alias("extra"))).alias("cut")).scalar()


def shortfall(df: DataFrame, by, wanted, per_entity: tuple[str, int] | None = None) -> DataFrame:
    """`(by..., wanted, got)` of every group that cannot supply what is wanted of it.

    `wanted` is a number or a table `(by, quota)`, whose groups count even if they
    have no row. `per_entity` is (entity, cap): no entity supplies more than the cap.
    """
    by = [by] if isinstance(by, str) else list(by)
    if per_entity:
        entity, cap = per_entity
        sizes = df.where(F.col(entity).isNotNull()).groupBy(*by, entity).agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    else:
        sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    supply = sizes.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("got"))
    if isinstance(wanted, DataFrame):
        named = wanted.select(*by, F.col("quota").cast("bigint").alias("wanted"))
        joined = named.join(supply, by, "left") if by else named.withColumn("got", supply.scalar())
        joined = joined.withColumn("got", F.coalesce("got", F.lit(0)).cast("bigint"))
    else:
        joined = supply.withColumn("wanted", F.lit(wanted).cast("bigint"))
    return joined.where(F.col("got") < F.col("wanted")).select(*by, "wanted", "got")


def _require(strict: bool, short) -> None:
    """Stop if a group is short; `short` makes the table that says which."""
    if strict and not (found := short()).isEmpty():
        groups, missing = found.agg(F.count("*"), F.sum(F.col("wanted") - F.col("got"))).first()
        raise ValueError(f"{groups} groups are short of {missing} rows, for example {found.first().asDict()}; see sampling.shortfall")


def take_rounds(ranked: DataFrame, group, round_col: str, n: int, group_order=None, hashed: bool = False,
                sizes_from: DataFrame | None = None) -> DataFrame:
    """First n rows of the order (round, group): one of each group per round.

    Equivalent to a global sort with a limit, but only the last, partial round is
    ordered, and only over its groups. Group sizes may be counted on the cheaper
    frame `sizes_from`.
    """
    group = [group] if isinstance(group, str) else list(group)
    names = [f"__s{i}" for i in range(len(group))]
    sizes = (sizes_from or ranked).groupBy(*[F.col(g).alias(s) for g, s in zip(group, names)]).agg(F.count("*").alias("size"))
    cut = _fill_level(sizes, n)
    leveled = sizes.withColumn("__cut", cut)
    open_groups = leveled.where(F.col("size") > F.col("__cut.level"))
    order = group_order(names) if group_order else [F.col(s) for s in names]
    open_groups = open_groups.withColumns({f"__o{i}": o for i, o in enumerate(order)})
    lucky = rank(open_groups, [], [f"__o{i}" for i in range(len(order))], "__place", hashed) \
        .where(F.col("__place") <= F.col("__cut.extra")).select(*names, F.lit(1).alias("__bonus"))
    candidates = ranked.withColumn("__cut", cut).where(
        F.col("__cut").isNull() | (F.col(round_col) <= F.col("__cut.level") + 1))
    joined = candidates.join(lucky, _same([F.col(g) for g in group], [F.col(s) for s in names]), "left")
    kept = joined.where(F.col("__cut").isNull() | (F.col(round_col) <= F.col("__cut.level"))
                        | F.col("__bonus").isNotNull())
    return kept.select(*ranked.columns)


def round_robin_sample(df: DataFrame, group: str, n: int, identifier: str = "sample_id", seed=fixed.SEED,
                       strict: bool = True) -> DataFrame:
    """n rows, one from each group per round; `round` tells which. Fewer rows than n are an error unless not strict."""
    _require(strict, lambda: shortfall(df, [], n))
    ranked = shuffled_rank(df, [group], identifier, seed, "round")
    return take_rounds(ranked, group, "round", n,
                       lambda names: [hkey(names[0], seed), F.coalesce(text(names[0]), F.lit(""))],
                       hashed=True, sizes_from=df)


def nested_round_robin(df: DataFrame, groups, spread: str, n: int, order, strict: bool = True) -> DataFrame:
    """Round robin across groups; inside a group, round robin across `spread` in the given order.

    Missing keys count as 'unknown'. Fewer rows than n are an error unless not strict.
    """
    _require(strict, lambda: shortfall(df, [], n))

    def known(c):
        filled = F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")
        return F.when(F.coalesce(filled, F.lit("")) == "", F.lit("unknown")).otherwise(filled)

    named = df.withColumns({**{f"__g{i}": known(g) for i, g in enumerate(groups)}, "__spread": known(spread)})
    keys = [f"__g{i}" for i in range(len(groups))]
    turn = settled(rank(named, [*keys, "__spread"], order, "__turn"), "turns")
    position = rank(turn, keys, ["__turn", "__spread"], "round")
    return take_rounds(position, keys, "round", n, sizes_from=turn).drop("__turn", "__spread", *keys)


def group_top_up(df: DataFrame, group, domain: str, need: int, order, seed=fixed.SEED, strict: bool = True) -> DataFrame:
    """Whole groups, one per domain and round, until `need` rows; the last group is trimmed.

    A group belongs to the domain of its first record, and is known by its shuffle
    key, so long keys such as texts are not moved around. Fewer than `need` rows are an error; if not strict all are taken.
    """
    _require(strict, lambda: shortfall(df, [], need))
    records = df.withColumn("__grp", hkey(group, seed))
    table = settled(records.groupBy("__grp").agg(
        F.count("*").alias("__size"), F.min_by(F.col(domain), F.struct(*order)).alias("__dom")), "groups")
    turns = rank(table, ["__dom"], ["__grp"], "__round", hashed=True)
    total = running_sums(turns, [], ["__round", "__dom"], {"__upto": F.col("__size")})
    chosen = total.select(F.col("__grp").alias("__pick"), "__round", "__upto",
                          (F.col("__upto") - F.col("__size")).alias("__before")).where(F.col("__before") < need)
    picked = settled(records.join(chosen, F.col("__grp") == F.col("__pick")), "picked")
    whole = picked.where(F.col("__upto") <= need)
    last = rank(picked.where(F.col("__upto") > need), [], order, "__pos") \
        .where(F.col("__pos") <= need - F.col("__before"))
    return whole.select(*df.columns, F.col("__round").alias("round")).unionByName(
        last.select(*df.columns, F.col("__round").alias("round")))


def initial_cap(quota: int, groups, limit: int = fixed.INITIAL_ENTITY_CAP):
    """Cap that spreads a quota evenly over one-entity blocks."""
    return F.least(F.lit(limit), F.greatest(F.lit(1), F.ceil(F.lit(quota) / col(groups)).cast("int")))


def capped_quota(df: DataFrame, entity: str, cap: int, quota: int, by: str, order, strict: bool = True) -> DataFrame:
    """At most `cap` rows per entity, then at most `quota` per `by`, both in the given order.

    A group that its capped entities leave short of the quota is an error; if not strict it gives what it has.
    """
    _require(strict, lambda: shortfall(df, by, quota, (entity, cap)))
    capped = settled(first_per_group(df.where(F.col(entity).isNotNull()), [by, entity], order, cap, "entity_rank"), "capped")
    return rank(capped, [by], order, "position").where(F.col("position") <= quota)


def cap_sequence(cap0: int, limit: int = fixed.ENTITY_CAP_LIMIT) -> list[int]:
    caps = [cap0]
    while caps[-1] < limit:
        caps.append(min(caps[-1] * 2, limit))
    return caps


def escalating_cap(df: DataFrame, entity: str, cap0: int, quota: int, by: str, order,
                   limit: int = fixed.ENTITY_CAP_LIMIT, strict: bool = True) -> DataFrame:
    """Smallest cap of the doubling sequence that reaches the quota, then rows by (tier, order).

    Tiers below the last are taken whole; only the last tier is ranked. A group
    that even the highest cap leaves short is an error; if not strict it gives what it has.
    """
    _require(strict, lambda: shortfall(df, by, quota, (entity, max(limit, cap0))))
    usable = df.where(F.col(entity).isNotNull())
    caps = cap_sequence(cap0, limit)
    ranked = first_per_group(usable, [by, entity], order, caps[-1], "entity_rank")
    sizes = usable.groupBy(by, entity).agg(F.count("*").alias("clips"))
    reach = sizes.groupBy(F.col(by).alias("__by")).agg(
        *[F.sum(F.least(F.col("clips"), F.lit(c))).alias(f"r{i}") for i, c in enumerate(caps)])
    level = F.lit(len(caps) - 1)
    for i in reversed(range(len(caps))):
        level = F.when(F.col(f"r{i}") >= quota, F.lit(i)).otherwise(level)
    before = F.coalesce(*[F.when(F.col("level") == i, F.col(f"r{i-1}") if i else F.lit(0).cast("bigint"))
                          for i in range(len(caps))])
    reach = reach.withColumn("level", level).withColumn("below", before).select("__by", "level", "below")
    tier = F.lit(len(caps) - 1)
    for i in reversed(range(len(caps))):
        tier = F.when(F.col("entity_rank") <= caps[i], F.lit(i)).otherwise(tier)
    tiered = settled(ranked.withColumn("tier", tier).join(reach, F.col(by).eqNullSafe(F.col("__by")))
                     .where(F.col("tier") <= F.col("level")), "tiered")
    used = F.element_at(F.array(*[F.lit(c) for c in caps]), F.col("level") + 1).alias("cap_used")
    whole = tiered.where(F.col("tier") < F.col("level"))
    last = rank(tiered.where(F.col("tier") == F.col("level")), [by], order, "__place") \
        .where(F.col("__place") <= F.lit(quota) - F.col("below")).drop("__place")
    return whole.unionByName(last).select(*df.columns, "entity_rank", "tier", used)


def quota_sample(df: DataFrame, by: str, quotas: DataFrame, order, strict: bool = True) -> DataFrame:
    """The first rows of each group up to its own quota; groups without a quota are dropped.

    A group with fewer rows than its quota is an error unless not strict.
    """
    _require(strict, lambda: shortfall(df, by, quotas))
    wanted = df.join(quotas.select(by, "quota"), by)
    return rank(wanted, [by], order, "position").where(F.col("position") <= F.col("quota")).drop("quota")


def _arrivals(df: DataFrame, entity: str, n: int, order, payload: str | None) -> tuple[DataFrame, DataFrame]:
    """All rows that the arrival rule would take without an end, and a frame to measure ranks on."""
    named = df.withColumn(entity, F.coalesce(F.nullif(text(entity), F.lit("")), F.lit("UNKNOWN")))
    usable = F.col(payload).isNotNull() if payload else F.lit(True)
    seen = settled(running_sums(named, [entity], order, {
        "seen": F.lit(1).cast("bigint"), "usable_seen": usable.cast("bigint")}), "seen")
    first = usable & (F.col("usable_seen") == 1)
    taken = running_sums(seen, [], order, {"entities": first.cast("bigint")})
    allowed = F.greatest(F.lit(1), F.ceil(F.lit(n) / F.greatest(F.lit(1), F.col("entities"))))
    return taken.where(usable & (first | ((F.col("usable_seen") > 1) & (F.col("seen") <= allowed)))), seen


def arrival_shortfall(df: DataFrame, entity: str, n: int, order, payload: str | None = None) -> DataFrame:
    """`(wanted, got)` if the arrival rule takes fewer than n rows, else no row."""
    return shortfall(_arrivals(df, entity, n, order, payload)[0], [], n)


def arrival_capped_sample(df: DataFrame, entity: str, n: int, order, payload: str | None = None, strict: bool = True) -> DataFrame:
    """One pass in arrival order, in closed form.

    A row is taken when it is the first usable one of its entity, or while the
    rows seen of the entity are at most max(1, ceil(n / entities taken so far));
    the first n taken rows are the sample. Entities taken so far are a running
    count of first rows, so three running sums replace the sequential pass. Fewer than n rows are an
    error; if not strict they are the sample.
    """
    picked, seen = _arrivals(df, entity, n, order, payload)
    _require(strict, lambda: shortfall(picked, [], n))
    return rank(picked, [], order, "position", keys_from=seen).where(F.col("position") <= n).drop("usable_seen")


def best_per_group(df: DataFrame, group, metric: str, tie_order) -> DataFrame:
    """The largest row of each group; equal rows in the given order."""
    return first_per_group(df, [group] if isinstance(group, str) else group, [F.desc(metric), *tie_order], 1)


def spread_evenly(df: DataFrame, order, n: int) -> DataFrame:
    """Rows at positions floor(i * N / n) of the order; all rows when n >= N."""
    total = df.count()
    placed = rank(df, [], order, "__pos").withColumn("position", F.col("__pos") - 1).drop("__pos")
    if n >= total:
        return placed
    # some index i has floor(i * step) = position only near i = position / step
    step = F.lit(total / n)
    chosen = F.lit(False)
    for shift in (-1, 0, 1):
        i = F.ceil(F.col("position") / step) + shift
        chosen = chosen | ((F.floor(i * step) == F.col("position")) & (i >= 0) & (i < n))
    return placed.where(chosen)


def dedup_keep_first(df: DataFrame, key, order) -> DataFrame:
    """The first row of each key; the key is hashed, so long texts are not shuffled as keys."""
    keyed = df.withColumn("__key", F.sha2(text(key), 256))
    return first_per_group(keyed, ["__key"], order, 1).drop("__key")


def dedup_report(df: DataFrame, key) -> DataFrame:
    return df.agg(F.count("*").alias("rows"),
                  (F.countDistinct(F.sha2(F.coalesce(text(key), F.lit("")), 256)).alias("kept"))) \
        .withColumn("removed", F.col("rows") - F.col("kept"))


def stratified_take(df: DataFrame, strata, n: int, identifier: str = "sample_id", seed=fixed.SEED + 1,
                    strict: bool = True) -> DataFrame:
    """n shuffled rows per stratum; a short stratum is an error, or gives all it has if not strict."""
    _require(strict, lambda: shortfall(df, strata, n))
    keyed = df.withColumn(_H, hkey(identifier, seed))
    return first_per_group(keyed, strata, [_H, identifier], n, "position", hashed=True).drop(_H)


def short_strata(df: DataFrame, strata, n: int) -> DataFrame:
    return df.groupBy(*strata).agg(F.count("*").alias("available")).where(F.col("available") < n)


def occurrence_index(df: DataFrame, group: str, order, out: str = "occurrence") -> DataFrame:
    """0-based running count inside the group."""
    ranked = rank(df, [group], order, out)
    return ranked.withColumn(out, F.col(out) - 1)
