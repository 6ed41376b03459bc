"""Stored digest trees, partition overwrite, and sketches that merge."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sievewright.operators import currency, joins, sampling, sketches
from sievewright.session import scratch_path


def base(spark, n=600):
    return spark.range(n).selectExpr("CAST(id AS STRING) AS sample_id", "id % 7 AS a", "IF(id % 5 = 0, NULL, concat('t', id)) AS b")


@pytest.mark.parametrize("changes", [[], [17], [17, 18, 333], list(range(600))])
def test_stored_tree_gives_what_the_whole_comparison_gives(spark, changes):
    path, fresh = scratch_path(spark, "pub"), base(spark)
    currency.publish(fresh, "sample_id", path, 2)
    new = fresh.withColumn("b", F.when(F.col("sample_id").cast("int").isin(changes or [-1]), F.lit("new")).otherwise(F.col("b")))
    assert currency.check_stored(new, "sample_id", path, 2).collect() == joins.check_current(new, fresh).collect()
    found = currency.differing_leaves(currency.digest_tree(new, "sample_id", 2), spark.read.parquet(f"{path}/tree"), 2)
    wanted = fresh.where(F.col("sample_id").cast("int").isin(changes or [-1])).select(currency.leaf_of("sample_id", 2)).distinct().collect()
    assert found == sorted(r[0] for r in wanted)
    if len(found) == 1:
        plan = currency.published_rows(spark, path, found)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "__leaf" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_stored_tree_sees_added_removed_and_repeated_rows(spark):
    path, fresh = scratch_path(spark, "pub"), base(spark, 50).unionAll(base(spark, 1).withColumn("sample_id", F.lit(None).cast("string")))
    currency.publish(fresh, "sample_id", path, 1)
    for new in (fresh.where("sample_id <> '3'"), fresh.unionAll(fresh.where("sample_id = '3'")), fresh.where("sample_id IS NOT NULL"), fresh.limit(0), fresh):
        assert currency.check_stored(new, "sample_id", path, 1).collect() == joins.check_current(new, fresh).collect()
    nothing = scratch_path(spark, "pub")
    currency.publish(fresh.limit(0), "sample_id", nothing, 1)
    assert currency.check_stored(fresh, "sample_id", nothing, 1).first()["missing"] == 51


def test_overwrite_leaves_other_partitions_alone(spark):
    path = scratch_path(spark, "parts")
    rows = spark.range(40).selectExpr("id", "concat('p', id % 4) AS p")
    rows.repartition("p").write.partitionBy("p").parquet(path)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    time.sleep(0.01)
    joins.overwrite_partitions(spark.createDataFrame([(99, "p1")], "id long, p string"), path, "p")
    after = files()
    assert {k: v for k, v in before.items() if "p=p1" not in k} == {k: v for k, v in after.items() if "p=p1" not in k}
    assert [r.id for r in spark.read.parquet(path).where("p = 'p1'").collect()] == [99]


def test_merged_quantiles_are_within_the_rank_error(spark):
    rows = spark.range(60000).selectExpr("id % 16 AS part", "CAST(hash(id) AS DOUBLE) AS v", "'g' AS g").withColumn("v", F.when(F.col("part") == 3, F.lit(float("nan"))).otherwise(F.col("v")))
    found = sketches.merged_quantiles(sketches.quantile_sketches(rows, ["part", "g"], "v"), ["g"], {"q": 0.3, "r": 0.9}).first()
    values = sorted(r.v for r in rows.where("part <> 3").select("v").collect())
    assert found.n == len(values)
    for got, p in ((found.q, 0.3), (found.r, 0.9)):
        assert abs(sum(v <= got for v in values) / len(values) - p) < 0.0133 * 1.5


def test_merged_entities_are_within_the_error(spark):
    rows = spark.range(200000).selectExpr("id % 9 AS part", "IF(id % 3 = 0, 'x', 'y') AS s", "IF(id % 50 = 0, ' ', CAST(IF(id % 3 = 0, id % 30000, id % 40000 + 15000) AS STRING)) AS e")
    kept = sketches.entity_sketches(rows, ["part", "s"], "e")
    exact = {r.s: r.n for r in rows.where("trim(e) <> ''").groupBy("s").agg(F.countDistinct("e").alias("n")).collect()}
    for r in sketches.merged_entities(kept, ["s"]).collect():
        assert abs(r.entities / exact[r.s] - 1) < 0.05
    both = {s: {r.e for r in rows.where(F.col("s") == s).where("trim(e) <> ''").select("e").distinct().collect()} for s in "xy"}
    shared = sketches.shared_estimate(kept, "s", "x", "y").first().shared
    assert abs(shared - len(both["x"] & both["y"])) < 0.05 * len(both["x"] | both["y"])


def test_short_draws_are_errors(spark):
    rows = spark.range(100).selectExpr("id", "concat('e', id % 4) AS e", "'g' AS g", "concat('d', id % 3) AS d")
    for draw in (lambda **k: sampling.group_top_up(rows, "e", "d", 500, ["id"], **k), lambda **k: sampling.capped_quota(rows, "e", 5, 50, "g", ["id"], **k),
                 lambda **k: sampling.arrival_capped_sample(rows, "e", 500, ["id"], **k)):
        with pytest.raises(ValueError, match="short of"):
            draw()
        assert 0 < draw(strict=False).count() <= 100
