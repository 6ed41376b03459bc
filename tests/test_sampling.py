"""Sampling and splitting against sequential brute force on small fixtures."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sievewright.operators import derive, gates, joins, sampling, splits


def key(seed, value):
    return hashlib.sha256(f"{seed}|{value}".encode()).hexdigest()


def manifest(n=400, groups=23, seed=5):
    """(id, group, label): one group holds a third of the rows."""
    rng = random.Random(seed)
    return [(f"s{i:04d}", "hot" if rng.random() < 0.33 else f"g{rng.randrange(groups):02d}", rng.choice(["real", "fake"])) for i in range(n)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(manifest(), "sample_id string, g string, label string").repartition(7)


@pytest.mark.parametrize("n", [0, 1, 57, 399, 400, 900])
def test_round_robin(df, n):
    pools = defaultdict(list)
    for i, g, _ in manifest():
        pools[g].append(i)
    for g in pools:
        pools[g].sort(key=lambda i: (key(42, i), i))
    picked, turn = set(), 0
    while len(picked) < min(n, 400):
        for g in sorted(pools, key=lambda g: (key(42, g), g)):
            if turn < len(pools[g]) and len(picked) < n:
                picked.add(pools[g][turn])
        turn += 1
    assert {r.sample_id for r in sampling.round_robin_sample(df, "g", n, strict=False).collect()} == picked


def test_round_robin_strict(df):
    with pytest.raises(ValueError):
        sampling.round_robin_sample(df, "g", 401)


@pytest.mark.parametrize("n", [1, 40, 150, 400])
def test_arrival_capped(spark, small_cells, n):
    rows = [(i, g, None if i % 7 == 0 else b"x") for i, (_, g, _) in enumerate(manifest())]
    seen, chosen, taken = Counter(), set(), []
    for i, g, payload in rows:
        seen[g] += 1
        if len(taken) >= n:
            break
        if (g not in chosen or seen[g] <= max(1, math.ceil(n / max(1, len(chosen))))) and payload is not None:
            taken.append(i)
            chosen.add(g)
    frame = spark.createDataFrame(rows, "i int, g string, payload binary")
    got = sampling.arrival_capped_sample(frame, "g", n, ["i"], "payload", strict=False).orderBy("position").collect()
    assert [r.i for r in got] == taken


@pytest.mark.parametrize("n,total", [(1, 10), (7, 10), (10, 10), (30, 10), (160, 997)])
def test_spread_evenly(spark, n, total):
    got = sorted(r.id for r in sampling.spread_evenly(spark.range(total), ["id"], n).collect())
    step = total / n
    assert got == (list(range(total)) if n >= total else [int(i * step) for i in range(n)])


def test_top_up_takes_whole_groups_but_trims_the_last(df, spark):
    rows = df.withColumn("domain", F.expr("CASE WHEN g < 'g10' THEN 'a' ELSE 'b' END"))
    got = [r.g for r in sampling.group_top_up(rows, "g", "domain", 100, ["sample_id"]).collect()]
    sizes, counts = Counter(g for _, g, _ in manifest()), Counter(got)
    assert len(got) == 100
    assert sum(counts[g] < sizes[g] for g in counts) <= 1


def test_escalation_never_repeats_and_stops_at_quota(df):
    got = sampling.escalating_cap(df.withColumn("all", F.lit("x")), "g", 3, 200, "all", ["sample_id"]).collect()
    assert len(got) == 200 and len({r.sample_id for r in got}) == 200
    sizes = Counter(g for _, g, _ in manifest())
    used = next(c for c in sampling.cap_sequence(3) if sum(min(n, c) for n in sizes.values()) >= 200)
    assert {r.cap_used for r in got} == {used}


def test_nested_round_robin_is_even(df):
    got = sampling.nested_round_robin(df, ["label"], "g", 100, ["sample_id"]).collect()
    assert Counter(r.label for r in got) == {"real": 50, "fake": 50}
    assert max(Counter((r.label, r.g) for r in got).values()) <= 4


def test_deal_is_balanced_within_every_stratum(spark):
    rows = spark.range(1000).selectExpr("CAST(id AS STRING) AS sample_id", "'s' || id % 3 AS source_dataset",
                                        "CASE WHEN id % 2 = 0 THEN 'real' ELSE 'fake' END AS label", "'x' AS language_type")
    dealt = derive.deal_conditions(rows).groupBy("source_dataset", "label", "augmentation_condition").count().collect()
    per = defaultdict(list)
    for r in dealt:
        per[r.source_dataset, r.label].append(r["count"])
    assert all(len(v) == 11 and max(v) - min(v) <= 1 for v in per.values())


# ---- splits ----

def sequential_greedy(sizes, targets):
    held, out = dict.fromkeys(targets, 0), {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        best = max(targets, key=lambda s: targets[s] - held[s])
        out[g] = best
        held[best] += sizes[g]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_greedy_pattern_equals_the_loop(seed):
    rng = random.Random(seed)
    for _ in range(200):
        k = rng.randint(2, 4)
        deficit = [rng.randint(-40, 200) for _ in range(k)]
        size, count = rng.randint(1, 30), rng.randint(1, 60)
        loop, want = list(deficit), []
        for _ in range(count):
            best = max(range(k), key=lambda i: loop[i])
            want.append(best)
            loop[best] -= size
        ours = list(deficit)
        pieces = splits._pick_pattern(ours, size, count)
        got = [cycle[(p - start) % len(cycle)] for start, end, cycle in pieces for p in range(start, end)]
        assert got == want and ours == loop and len(pieces) <= k


@pytest.mark.parametrize("targets", [None, {"train": 250, "validation": 90, "test": 60}])
def test_greedy_split(df, small_cells, targets):
    sizes = Counter(g for _, g, _ in manifest())
    wanted = targets or {s: Fraction(p, 100) * 400 for s, p in (("train", 70), ("validation", 15), ("test", 15))}
    got = {r.g: r.new_split for r in splits.greedy_assignment(df, "g", targets).collect()}
    assert got == sequential_greedy(sizes, wanted)


def test_greedy_split_of_many_equal_groups(spark, small_cells):
    rows = spark.range(600).selectExpr("CAST(id AS STRING) AS i", "'u' || lpad(CAST(id AS STRING), 4, '0') AS g")
    got = {r.g: r.new_split for r in splits.greedy_assignment(rows, "g").collect()}
    want = sequential_greedy({f"u{i:04d}": 1 for i in range(600)}, {"train": Fraction(420), "validation": Fraction(90), "test": Fraction(90)})
    assert got == want


def test_greedy_multi_spreads_every_value(spark, small_cells):
    """Shares of rows and of every value, over groups of very different sizes, one with a fifth of all rows."""
    rng = random.Random(3)
    rows = [("big", rng.choice("ab")) for _ in range(1200)]
    for k in range(300):
        mostly = rng.choice("aab")
        rows += [(f"p{k:03d}", mostly if rng.random() < 0.8 else rng.choice("abc")) for _ in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "g string, a string")
    split = {r.group_key: r.new_split for r in splits.greedy_split_multi(df, "g", "a", ["a", "b", "c"]).collect()}
    assert set(split) == {g for g, _ in rows}
    got = Counter((split[g], a) for g, a in rows)
    by_split, by_value = Counter(split[g] for g, _ in rows), Counter(a for _, a in rows)
    for name, share in (("train", .7), ("validation", .15), ("test", .15)):
        assert abs(by_split[name] / len(rows) - share) < 0.01
        for value in "abc":
            assert got[name, value] > 0 and abs(got[name, value] / by_value[value] - share) < 0.12


def test_deal_cycle():
    cycle = splits.deal_cycle({"train": 70, "validation": 15, "test": 15})
    assert cycle[:3] == ["train", "validation", "test"] and Counter(cycle) == {"train": 14, "validation": 3, "test": 3}
    assert splits.deal_cycle({"a": 50, "b": 50}) == ["a", "b"]


def test_hash_split_moves_no_group_when_the_table_grows(spark):
    small = spark.range(4000).selectExpr("CAST(id % 900 AS STRING) AS g")
    large = spark.range(40000).selectExpr("CAST(IF(id % 31 = 0, NULL, id % 9000) AS STRING) AS g")
    before = {r.g: r.split for r in splits.hash_split(small, "g").distinct().collect()}
    after = {r.g: r.split for r in splits.hash_split(large, "g").distinct().collect()}
    assert all(after[g] == s for g, s in before.items()) and None in after
    share = Counter(after.values())
    assert abs(share["train"] - 6300) < 200 and abs(share["test"] - 1350) < 150
    thirds = Counter(r.split for r in splits.hash_split(large, "g", {"a": 1, "b": 1.5, "c": 0.5}).select("g", "split").distinct().collect())
    assert abs(thirds["b"] - 4500) < 200 and abs(thirds["c"] - 1500) < 150


def test_greedy_multi_at_many_groups(spark):
    """Far more groups than count vectors, rows without a group among them: one path at every size."""
    df = spark.range(60_000).select(F.expr("CASE WHEN id % 50 > 0 THEN concat('g', id % 6001) END").alias("g"),
                                    F.expr("CASE WHEN id % 7 = 0 THEN 'b' ELSE 'a' END").alias("a"))
    split = splits.greedy_split_multi(df, "g", "a", ["a", "b"])
    assert split.count() == df.select("g").distinct().count()
    got = {r.new_split: r.n for r in split.groupBy("new_split").agg(F.sum("total").alias("n")).collect()}
    assert abs(got["train"] - 42_000) < 1500 and abs(got["validation"] - 9_000) < 1500


def test_greedy_multi_supplies_a_missing_value(spark):
    rows = [(f"g{i}", "common") for i in range(20) for _ in range(10)] + [(f"r{i}", "rare") for i in range(3)]
    df = spark.createDataFrame(rows, "g string, a string")
    split = splits.greedy_split_multi(df, "g", "a", ["common", "rare"])
    found = df.join(split.withColumnRenamed("group_key", "g"), "g").where("a = 'rare'").select("new_split").distinct()
    assert found.count() == 3


@pytest.mark.parametrize("make", [
    lambda d: splits.group_shuffle_split(d, "g"), lambda d: splits.greedy_split(d, "g"),
    lambda d: splits.greedy_split(d, "g", by="label")])
def test_splits_keep_rows_and_groups(df, make):
    out = make(df.withColumn("g", F.concat("label", F.lit("/"), "g")))
    assert out.count() == 400
    assert joins.leaky_groups(out, "g").count() == 0
    leak = gates.split_leakage(out.withColumn("source_dataset", F.lit("s")), "g").collect()
    assert all(r.train_validation + r.train_test + r.validation_test == 0 for r in leak)


def test_splits_ignore_partitioning(df):
    def assignment(d):
        return {r.sample_id: r.split for r in splits.group_shuffle_split(d, "g").collect()}
    assert assignment(df) == assignment(df.repartition(3, "label"))


def test_null_group_is_one_group(spark):
    df = spark.range(50).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL ELSE 'g' || id % 7 END AS g")
    out = splits.group_shuffle_split(df, "g")
    assert out.count() == 50 and out.where("g IS NULL").select("split").distinct().count() == 1


def test_row_split_sizes(spark):
    out = splits.row_split(spark.range(101).selectExpr("CAST(id AS STRING) AS i"), "i")
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 70, "validation": 15, "test": 16}


def test_short_supply_speaks(df):
    quotas = df.sparkSession.createDataFrame([("nobody", 1)], "label string, quota int")
    for draw in (lambda: sampling.nested_round_robin(df, ["label"], "g", 500, ["sample_id"]), lambda: sampling.quota_sample(df, "label", quotas, ["sample_id"]),
                 lambda: sampling.escalating_cap(df, "g", 1, 390, "label", ["sample_id"], limit=2), lambda: sampling.stratified_take(df, ["label"], 401)):
        with pytest.raises(ValueError, match="short"):
            draw()
    assert sampling.shortfall(df, "label", quotas).first().asDict() == {"label": "nobody", "wanted": 1, "got": 0}
