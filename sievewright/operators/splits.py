"""Assignment of whole groups to train, validation and test."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import ceil, gcd, lcm

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sievewright import fixed_values as fixed
from sievewright.functions.keys import hkey, text
from sievewright.operators.running import rank, running_sums
from sievewright.operators.sampling import shuffled_rank
from sievewright.session import settled

def group_shuffle_split(df: DataFrame, group: str, seed=fixed.SEED, missing: str = "UNKNOWN_SPEAKER",
                        out: str = "split") -> DataFrame:
    """70/15/15 of the groups (not rows) in shuffled order; missing keys form one group."""
    train, _, test = (fixed.SPLIT_PERCENT[s] for s in fixed.SPLITS)
    keyed = df.withColumn("__grp", F.coalesce(text(group), F.lit(missing)))
    groups = keyed.select("__grp").distinct()
    total = groups.agg(F.count("*").alias("n")).scalar()
    placed = shuffled_rank(groups, [], "__grp", seed, "__place").withColumn("__n", total)
    n_train = F.floor(F.col("__n") * train / 100)
    n_val = F.floor((F.col("__n") - n_train) / 2)
    split = (F.when(F.col("__place") <= n_train, "train")
             .when(F.col("__place") <= n_train + n_val, "validation").otherwise("test"))
    return keyed.join(placed.select("__grp", split.alias(out)), "__grp").drop("__grp")


def hash_split(df: DataFrame, group: str, percent: dict = fixed.SPLIT_PERCENT, seed=fixed.SEED, missing: str = "UNKNOWN_SPEAKER",
               out: str = "split") -> DataFrame:
    """Each group to the split in whose share of the hash range its key falls; missing keys form one group.

    Needs neither a shuffle nor the other groups: a table may grow, or be split a part at a time, and no group
    moves. Shares hold in expectation, by groups and not by rows. The hash is the first 52 bits
    of the seeded key, so shares may be fractions of a percent.
    """
    point = F.conv(F.substring(hkey(F.coalesce(text(group), F.lit(missing)), seed), 1, 13), 16, 10).cast("bigint")
    scale, reach, split = Fraction(16 ** 13, sum(Fraction(str(p)) for p in percent.values())), Fraction(0), F.lit(list(percent)[-1])
    borders = []
    for name, share in percent.items():
        reach += Fraction(str(share))
        borders.append((name, ceil(reach * scale)))
    for name, border in reversed(borders[:-1]):
        split = F.when(point < border, name).otherwise(split)
    return df.withColumn(out, split)


def row_split(df: DataFrame, identifier: str, percent: dict = fixed.SPLIT_PERCENT, seed=fixed.SEED,
              out: str = "split") -> DataFrame:
    """Shuffled rows: the first floor(n*f) to train, the next to validation, the rest to test."""
    total = df.agg(F.count("*").alias("n")).scalar()
    placed = shuffled_rank(df, [], identifier, seed, "__place").withColumn("__n", total)
    a = F.floor(F.col("__n") * percent["train"] / 100)
    b = a + F.floor(F.col("__n") * percent["validation"] / 100)
    return placed.withColumn(out, F.when(F.col("__place") <= a, "train")
                             .when(F.col("__place") <= b, "validation").otherwise("test")).drop("__place", "__n")


# ---- greedy: each group to the split with the largest remaining deficit ----

def _pick_pattern(deficit: list[int], size: int, count: int):
    """Picks of `count` equal groups as (start, end, cycle) pieces; updates the deficits.

    While no other split overtakes, the splits within one group size of the
    leader are picked in a fixed cycle. Each piece ends when a further split joins.
    """
    pieces, start = [], 0
    while start < count:
        order = sorted(range(len(deficit)), key=lambda i: (-deficit[i], i))
        lead = order[0]
        cycle = [i for i in order if (deficit[i], -i) > (deficit[lead] - size, -lead)]
        rounds = -(-(count - start) // len(cycle))
        for i in order[len(cycle):]:
            gap = deficit[lead] - deficit[i]
            joins = gap // size + (0 if gap % size == 0 and i < lead else 1)
            rounds = min(rounds, max(1, joins - 1))
        end = min(count, start + rounds * len(cycle))
        pieces.append((start, end, cycle))
        for place, i in enumerate(cycle):
            deficit[i] -= size * ((end - start - place + len(cycle) - 1) // len(cycle))
        start = end
    return pieces


def _fold_classes(shares, absolute):
    """pandas function: pieces for every size class of one stratum, largest size first."""
    exact = [Fraction(str(s)) for s in shares]
    scale = lcm(*[f.denominator for f in exact])

    def fold(classes: pd.DataFrame) -> pd.DataFrame:
        classes = classes.sort_values("size", ascending=False)
        rows = 1 if absolute else int((classes["size"] * classes["members"]).sum())
        deficit = [int(f * scale) * rows for f in exact]
        out = []
        for size, members in zip(classes["size"].tolist(), classes["members"].tolist()):
            for start, end, cycle in _pick_pattern(deficit, size * scale, members):
                out.append((classes["stratum"].iat[0], size, start, end, cycle))
        return pd.DataFrame(out, columns=["stratum", "size", "start", "end", "cycle"])

    return fold


def greedy_assignment(df: DataFrame, group: str, targets: dict | None = None, by: str | None = None) -> DataFrame:
    """`(stratum, group, size, new_split)` of the greedy split.

    Groups go by size descending, then by key, each to the split whose target
    exceeds its rows most, ties to the earlier split. The result is that of the
    sequential loop, but the fold runs over distinct group sizes only: groups of
    equal size follow a repeating pattern, and each finds its split from its
    position. A stratum of N rows has fewer than sqrt(2N) distinct sizes.

    `targets` holds rows per split (ints) or percent shares (default 70/15/15).
    """
    absolute = targets is not None
    targets = targets or {s: p / 100 for s, p in fixed.SPLIT_PERCENT.items()}
    names = F.array(*[F.lit(s) for s in targets])
    stratum = F.coalesce(text(by), F.lit("")) if by else F.lit("")
    groups = df.groupBy(stratum.alias("stratum"), F.col(group)).agg(F.count("*").alias("size"))
    classes = groups.groupBy("stratum", "size").agg(F.count("*").alias("members"))
    pieces = classes.groupBy("stratum").applyInPandas(
        _fold_classes(list(targets.values()), absolute),
        "stratum string, size bigint, start bigint, end bigint, cycle array<int>")
    patterns = pieces.groupBy("stratum", "size").agg(F.collect_list(F.struct("start", "end", "cycle")).alias("pieces"))
    placed = rank(groups, ["stratum", "size"], [text(group)], "__place").withColumn("__at", F.col("__place") - 1)
    joined = placed.join(patterns, ["stratum", "size"])
    piece = F.filter("pieces", lambda p: (p["start"] <= F.col("__at")) & (F.col("__at") < p["end"]))[0]
    found = joined.withColumn("__p", piece)
    turn = ((F.col("__at") - F.col("__p.start")) % F.size("__p.cycle")).cast("int")
    return found.select("stratum", group, "size",
                        F.element_at(names, F.element_at("__p.cycle", turn + 1) + 1).alias("new_split"))


def greedy_split(df: DataFrame, group: str, targets: dict | None = None, by: str | None = None,
                 out: str = "split") -> DataFrame:
    """Rows with the split of their group; see `greedy_assignment`."""
    assigned = greedy_assignment(df, group, targets, by).select(
        F.col("stratum").alias("__st"), F.col(group).alias("__grp"), F.col("new_split").alias("__new"))
    stratum = F.coalesce(text(by), F.lit("")) if by else F.lit("")
    joined = df.drop(out) if out in df.columns else df
    return joined.join(assigned, stratum.eqNullSafe(F.col("__st")) & F.col(group).eqNullSafe(F.col("__grp"))) \
        .withColumn(out, F.col("__new")).drop("__st", "__grp", "__new")


# ---- greedy over several attributes ----

CLASS_ROWS = 100_000        # classes of equal groups one task places in turn; session setting sievewright.fold.rows


class _Placement:
    """Splits being filled with groups that count in several attributes.

    All amounts are integers in hundredths of a row, so that no score is rounded.
    """

    def __init__(self, sums: list[int], percent: list[int], held: list[list[int]] | None = None):
        self.goals = [[total * p for total in sums] for p in percent]
        self.held = [list(h) for h in held] if held else [[0] * len(sums) for _ in percent]

    def merit(self, split: int, vector: tuple, before: int = 0):
        """What a group is worth to a split that took `before` more like it: (fit - overshoot / 2, fewer rows), doubled."""
        fit = over = load = 0
        for goal, held, amount in zip(self.goals[split], self.held[split], vector):
            held += before * amount
            fit += min(100 * amount, max(0, goal - 100 * held))
            over += max(0, 100 * (held + amount) - goal)
            load += held
        return 2 * fit - over, -load

    def run(self, vector: tuple, count: int) -> tuple[int, int]:
        """The split that takes the next group of this vector, and how many it takes in a row.

        Taking a group lowers a split's own merit and no other's, so the length of
        the row is found by bisection.
        """
        merits = [self.merit(s, vector) for s in range(len(self.goals))]
        best = max(range(len(merits)), key=lambda s: (merits[s], -s))
        rivals = [(merits[s], -s) for s in range(len(merits)) if s != best]
        low, high = 1, count
        while low < high:
            middle = (low + high + 1) // 2
            if all((self.merit(best, vector, middle - 1), -best) > r for r in rivals):
                low = middle
            else:
                high = middle - 1
        self.add(best, vector, low)
        return best, low

    def add(self, split: int, vector: tuple, times: int):
        self.held[split] = [h + times * v for h, v in zip(self.held[split], vector)]


def _fold_block(columns, percent, sums, held):
    """pandas function: pieces of the classes of one block, in order; a last row a split holds what the split has then."""
    def fold(classes: pd.DataFrame) -> pd.DataFrame:
        placement, out = _Placement(sums, list(percent.values()), held), []
        for _, _, count, *vector in classes.sort_values("turn")[["block", "turn", "members", "total", *columns]].itertuples(index=False, name=None):
            at = 0
            while at < count:
                split, length = placement.run(tuple(vector[1:]), count - at)
                out.append((*vector, at, at + length, split))
                at += length
        out += [(None, *h, None, None, s) for s, h in enumerate(placement.held)]
        return pd.DataFrame(out, columns=["total", *columns, "start", "end", "split"]).astype("Int64")

    return fold


def _lent(pieces: DataFrame, columns, placement: _Placement) -> DataFrame:
    """Every split that holds nothing of an attribute gets one group from a split that keeps some.

    The lender is the smallest class (by total, then vector) that can spare a group, from its earliest
    split; the last group of the class there moves.
    """
    vector = ["total", *columns]
    for split, at in ((s, a) for s in range(len(placement.held)) for a in range(len(columns))):
        if placement.held[split][at]:
            continue
        spare = F.create_map(*[F.lit(x) for s, h in enumerate(placement.held) for x in (s, h[at])])[F.col("split").cast("int")]
        offer = pieces.where((F.col(columns[at]) > 0) & (F.col("split") != split) & (F.col("start") < F.col("end")) & (spare > F.col(columns[at]))) \
            .orderBy(*vector, "split", F.desc("end")).first()
        if offer is None:
            continue
        amounts = tuple(offer[c] for c in columns)
        placement.add(offer["split"], amounts, -1)
        placement.add(split, amounts, 1)
        same = F.struct(*vector, "start", "split") == F.struct(*[F.lit(offer[c]).cast("bigint").alias(c) for c in (*vector, "start", "split")])
        moved = pieces.where(same).withColumns({"start": F.col("end") - 1, "split": F.lit(split).cast("bigint")})
        pieces = pieces.withColumn("end", F.when(same, F.col("end") - 1).otherwise(F.col("end"))).unionByName(moved)
    return pieces


def greedy_split_multi(df: DataFrame, group: str, attribute: str, values,
                       percent: dict = fixed.SPLIT_PERCENT) -> DataFrame:
    """`(group_key, total, new_split)`: whole groups placed so that each attribute value nears its share.

    Groups go by total descending, then by their counts of the values, then by key; each to the split with the best
    (fit - overshoot / 2, fewer rows), ties to the earlier split. A last pass supplies splits that lack a value. Rows without a
    group form one group with a NULL key. Groups with equal counts are interchangeable, so the placement runs over classes
    of equal groups, and each group finds its split from its place in its class.

    The rule is sequential. Classes are cut in order into blocks of `sievewright.fold.rows`; a task places one block,
    and only what the splits hold then goes on, through the driver, to the next. So memory and reads of a task are
    bounded and the time grows with the number of classes.
    """
    columns = [f"a{i}" for i in range(len(values))]
    vector, names = ["total", *columns], list(percent)
    groups = settled(df.groupBy(text(group).alias("group_key")).agg(
        F.count("*").alias("total"), *[F.count_if(F.col(attribute) == v).alias(c) for v, c in zip(values, columns)]), "groups")
    size = int(df.sparkSession.conf.get("sievewright.fold.rows", str(CLASS_ROWS)))
    classes = rank(groups.groupBy(*vector).agg(F.count("*").alias("members")), [], [-F.col("total"), *columns], "turn")
    classes = settled(classes.withColumn("block", F.floor((F.col("turn") - 1) / size)), "classes")
    found = classes.agg(F.coalesce(F.max("block"), F.lit(-1)).alias("last"), *[F.coalesce(F.sum(F.col(c) * F.col("members")), F.lit(0)).alias(c) for c in columns]).first()
    sums = [found[c] for c in columns]
    placement, made = _Placement(sums, list(percent.values())), []
    schema = ", ".join(f"{c} bigint" for c in (*vector, "start", "end", "split"))
    for block in range(found["last"] + 1):
        fold = _fold_block(columns, percent, sums, placement.held)
        part = settled(classes.where(F.col("block") == block).groupBy("block").applyInPandas(fold, schema), "pieces")
        state = {r["split"]: [r[c] for c in columns] for r in part.where("total IS NULL").collect()}
        placement.held = [state[s] for s in range(len(names))]
        made.append(part.where("total IS NOT NULL"))
    pieces = reduce(DataFrame.unionByName, made) if made else df.sparkSession.createDataFrame([], schema)
    patterns = _lent(pieces, columns, placement).groupBy(*vector).agg(F.collect_list(F.struct("start", "end", "split")).alias("pieces"))
    placed = rank(groups, vector, [F.col("group_key").isNotNull(), F.col("group_key")], "__place").join(patterns, vector)
    piece = F.filter("pieces", lambda p: (p["start"] < F.col("__place")) & (F.col("__place") <= p["end"]))[0]
    return placed.select("group_key", "total", F.element_at(F.array(*[F.lit(s) for s in names]), (piece["split"] + 1).cast("int")).alias("new_split"))


# ---- dealing over several attributes ----

def deal_cycle(percent: dict) -> list[str]:
    """The splits in the order in which equal groups are dealt: each once, then always the one furthest below its share."""
    whole = gcd(*percent.values())
    quota = {s: p // whole for s, p in percent.items()}
    cycle = list(quota)
    while len(cycle) < sum(quota.values()):
        step = len(cycle) + 1
        open_ = [s for s in quota if cycle.count(s) < quota[s]]
        cycle.append(max(open_, key=lambda s: (quota[s] * step - cycle.count(s) * sum(quota.values()), -list(quota).index(s))))
    return cycle


def dealt_split_multi(df: DataFrame, group: str, attribute: str, values,
                       percent: dict = fixed.SPLIT_PERCENT) -> DataFrame:
    """`(group_key, total, new_split)`: whole groups placed so that each attribute value nears its share.

    Unlike those of `greedy_split_multi`, groups are not placed one after the other but dealt. A group belongs to the stratum of the rarest value
    it holds (fewest groups, ties to the earlier value; groups without any come last). In a stratum, groups go by total
    descending, then by their counts of the values, then by key, and are dealt in `deal_cycle`: neighbours
    are alike, so every value is spread by its shares, and any stratum of at least as many groups
    as splits reaches every split. Uneven sizes are then settled in each stratum: a split with rows too many gives the smallest of its groups,
    last places first, up to its excess, to the splits with rows too few in turn; the first round of dealing
    stays. Rows without a group form one group with a NULL key.

    Both steps are running sums, so no group table sits in one task. Counts by value and by stratum and split reach the driver.
    """
    columns = [f"a{i}" for i in range(len(values))]
    names, n = list(percent), len(percent)
    groups = settled(df.groupBy(text(group).alias("group_key")).agg(
        F.count("*").alias("total"), *[F.count_if(F.col(attribute) == v).alias(c) for v, c in zip(values, columns)]), "groups")
    held = groups.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in columns]).first() if columns else ()
    rarest = sorted(range(len(columns)), key=lambda i: (held[i], i))
    stratum = F.coalesce(*[F.when(F.col(columns[i]) > 0, at) for at, i in enumerate(rarest)], F.lit(len(columns)))
    order = [-F.col("total"), *columns, F.col("group_key").isNotNull(), F.col("group_key")]
    placed = rank(groups.withColumn("stratum", stratum), ["stratum"], order, "place")
    cycle = deal_cycle(percent)
    dealt = settled(placed.select("group_key", "total", "stratum", "place", F.element_at(
        F.array(*[F.lit(s) for s in cycle]), ((F.col("place") - 1) % len(cycle) + 1).cast("int")).alias("split")), "dealt")
    rows = {(r["stratum"], r["split"]): r["n"] for r in dealt.groupBy("stratum", "split").agg(F.sum("total").alias("n")).collect()}
    hundred = sum(percent.values())
    limits, bases, reaches = [], [], []
    for at in sorted({k for k, _ in rows}):
        whole = sum(rows.get((at, s), 0) for s in names)
        excess = {s: hundred * rows.get((at, s), 0) - percent[s] * whole for s in names}      # in hundredths of a row
        before = reach = 0
        takers = []
        for s in names:
            if excess[s] > 0:
                limits += [F.lit(f"{at} {s}"), F.lit(excess[s])]
                bases += [F.lit(f"{at} {s}"), F.lit(before)]
                before += excess[s]
            elif excess[s] < 0:
                reach -= excess[s]
                takers.append(F.struct(F.lit(reach).cast("bigint").alias("reach"), F.lit(s).alias("split")))
        if takers:
            reaches += [F.lit(at), F.array(*takers)]
    if not limits:
        return dealt.select("group_key", "total", F.col("split").alias("new_split"))
    cell = F.concat_ws(" ", "stratum", "split")
    limit, base = (F.coalesce(F.create_map(*m)[cell], F.lit(0)) for m in (limits, bases))
    free = (F.col("place") > n) & (hundred * F.col("total") <= limit)
    summed = running_sums(dealt.withColumn("free", free), ["stratum", "split"], [-F.col("place")],
                          {"upto": F.when(F.col("free"), F.col("total")).otherwise(0)})
    middle = base + hundred * F.col("upto") - F.floor(hundred * F.col("total") / 2)
    takers = F.create_map(*reaches)[F.col("stratum")]
    taker = F.coalesce(F.get(F.filter(takers, lambda t: middle < t["reach"]), F.lit(0)), F.element_at(takers, -1))["split"]
    moved = F.col("free") & (hundred * F.col("upto") <= limit)
    return summed.select("group_key", "total", F.when(moved, taker).otherwise(F.col("split")).alias("new_split"))
