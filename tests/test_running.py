"""Ranks and quantiles against plain windows, with a hot group and forced cells."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from sievewright.operators import running


@pytest.fixture
def skewed(spark):
    """A third of the rows in one group, one group NULL, repeated values."""
    return spark.range(3000).select(
        "id", F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE 'g' || id % 37 END").alias("g"),
        F.expr("(id * 7919) % 101").alias("v"))


def test_rank(spark, small_cells, skewed):
    ours = running.rank(skewed, ["g"], ["v", "id"], "r").select("id", "r")
    plain = skewed.select("id", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).cast("bigint").alias("r"))
    assert ours.exceptAll(plain).count() == 0 and ours.count() == 3000


def test_cells_split_the_hot_group(spark, small_cells, skewed):
    cells = running._with_cells(skewed, ["g"], ["v", "id"], 3000, 3000, False, skewed)
    assert cells.where("g = 'hot'").select("__cell").distinct().count() > 10


def test_rank_is_stable_under_repartition(spark, small_cells, skewed):
    a = running.rank(skewed, [], ["v", "id"], "r").select("id", "r")
    b = running.rank(skewed.repartition(13, "v").coalesce(5), [], ["v", "id"], "r").select("id", "r")
    assert a.exceptAll(b).count() == 0


def test_running_sums_with_totals(spark, small_cells, skewed):
    ours = running.running_sums(skewed, ["g"], ["v", "id"], {"s": F.col("id")}, totals={"t": "s"}).select("id", "s", "t")
    w = Window.partitionBy("g")
    plain = skewed.select("id", F.sum("id").over(w.orderBy("v", "id")).alias("s"), F.sum("id").over(w).alias("t"))
    assert ours.exceptAll(plain).count() == 0


@pytest.mark.parametrize("k", [3, 1500])
def test_first_per_group(spark, small_cells, skewed, k):
    ours = running.first_per_group(skewed, ["g"], ["v", "id"], k).select("id")
    plain = skewed.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).where(F.col("r") <= k)
    assert sorted(r.id for r in ours.collect()) == sorted(r.id for r in plain.collect())


def test_group_limit_reaches_the_plan(skewed):
    plan = running.first_per_group(skewed, ["g"], ["v", "id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60))
def test_quantiles_equal_percentile(spark, values):
    df = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(values)], "g string, v int")
    ours = {r.g: (r.n, r.q1, r.med) for r in running.exact_quantiles(df, ["g"], "v", {"q1": 0.1, "med": 0.5}).collect()}
    want = df.where("v IS NOT NULL").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", 0.1).alias("q1"), F.median("v").alias("med")).collect()
    assert set(ours) == {r.g for r in want}
    for r in want:
        assert ours[r.g] == (r.n, pytest.approx(r.q1), pytest.approx(r.med))


def test_empty_input(spark):
    empty = spark.createDataFrame([], "g string, v int")
    assert running.rank(empty, ["g"], ["v"]).count() == 0
    assert running.exact_quantiles(empty, ["g"], "v", {"m": 0.5}).count() == 0
