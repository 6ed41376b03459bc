"""Streams over several batches, restarts, and equality with the batch result."""

import time

from pyspark.sql import functions as F

from sievewright.session import scratch_path
from sievewright.streaming import collect


def source(spark, rows, files=4):
    path = scratch_path(spark, "in")
    spark.createDataFrame(rows, "id int, k string").repartition(files, "id").write.parquet(path)
    return path, spark.read.parquet(path).schema


ROWS = [(i, "hot" if i % 3 else f"k{i % 5}") for i in range(300)]


def test_quota_over_batches_and_restart(spark):
    path, schema = source(spark, ROWS)
    sink, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")

    def run():
        stream = collect.file_stream(spark, path, schema, files_per_batch=1)
        collect.stream_quota(stream, "k", 17, ["id"], sink, checkpoint).awaitTermination()
        return collect.ledger(spark, sink, schema)

    got = run()
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {"hot": 17, **{f"k{i}": 17 for i in range(5)}}
    spark.createDataFrame([(1000, "hot"), (1001, "new")], schema).write.mode("append").parquet(path)
    again = {r.k: r["count"] for r in run().groupBy("k").count().collect()}
    assert again["hot"] == 17 and again["new"] == 1
    assert got.select("id").distinct().count() == got.count()


def test_incremental_collect_is_exactly_once(spark):
    path, schema = source(spark, ROWS)
    sink, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    for extra in ([], [(500, "z")], []):
        if extra:
            spark.createDataFrame(extra, schema).write.mode("append").parquet(path)
        collect.incremental_collect(collect.file_stream(spark, path, schema), sink, checkpoint).awaitTermination()
    assert spark.read.parquet(sink).exceptAll(spark.read.parquet(path)).count() == 0
    assert spark.read.parquet(sink).count() == 301


def test_quota_of_a_hot_key_is_what_one_counter_gives(spark):
    """Every row arrives in order of id, a file a batch; most rows share one key."""
    path = scratch_path(spark, "in")
    for k in range(4):
        spark.range(k * 500, k * 500 + 500).selectExpr("CAST(id AS INT) AS id", "IF(id % 10 < 9, 'hot', concat('k', id % 50)) AS k").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    sink, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    stream = collect.file_stream(spark, path, schema, files_per_batch=1)
    collect.stream_quota(stream, "k", 700, ["id"], sink, checkpoint).awaitTermination(100)
    hot = sorted(r.id for r in spark.read.parquet(sink).where("k = 'hot'").collect())
    assert hot == [i for i in range(2000) if i % 10 < 9][:700]
    assert spark.read.parquet(sink).where("k <> 'hot'").count() == 200


def test_quota_forgets_with_a_time_to_live(spark):
    path, schema = source(spark, [(i, "k") for i in range(40)], 1)
    sink, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")

    def run():
        collect.stream_quota(collect.file_stream(spark, path, schema), "k", 10, ["id"], sink, checkpoint, ttl_ms=1500).awaitTermination(100)
        return spark.read.parquet(sink).count()
    assert run() == 10
    time.sleep(3)
    spark.createDataFrame([(i, "k") for i in range(100, 140)], schema).coalesce(1).write.mode("append").parquet(path)
    assert run() == 20


def test_upsert_skips_done_and_redoes_lost(spark):
    path, schema = source(spark, [(i % 50, f"p{i % 50}") for i in range(200)])
    sink, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    inventory = spark.range(50).where("id <> 7").selectExpr("'p' || id AS k", "1 AS length")
    stream = collect.file_stream(spark, path, schema, files_per_batch=1)
    collect.idempotent_upsert(stream, "id", sink, checkpoint, inventory, "k").awaitTermination()
    assert {r.id for r in collect.live_ledger(spark, sink, schema, "id").collect()} >= set(range(50)) - {7}
    spark.createDataFrame([(7, "p7"), (8, "p8"), (60, "p60")], schema).coalesce(1).write.mode("append").parquet(path)
    collect.idempotent_upsert(collect.file_stream(spark, path, schema), "id", sink, checkpoint, inventory, "k").awaitTermination()
    last = spark.read.parquet(sink).where("NOT lost").groupBy("batch").agg(F.collect_set("id").alias("ids")).orderBy(F.desc("batch")).first()
    assert set(last.ids) == {7, 60}


def test_upsert_reads_only_touched_buckets_and_marks_losses(spark):
    path, schema = source(spark, [(i, f"p{i}") for i in range(200)], 1)
    sink, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    everything = spark.range(400).selectExpr("'p' || id AS k", "1 AS length")
    collect.idempotent_upsert(collect.file_stream(spark, path, schema), "id", sink, checkpoint, everything, "k", 32).awaitTermination()
    plan = collect.touched_entries(spark, sink, schema, [3, 5], 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = collect.touched_entries(spark, sink, schema, [3, 5], 10).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("bucket=3/" in r.f or "bucket=5/" in r.f for r in read)
    # of the ids 0 to 99 all files are lost; the next batch touches the buckets of three ids
    spark.createDataFrame([(1, "p1"), (150, "p150"), (300, "p300")], schema).coalesce(1).write.mode("append").parquet(path)
    left = everything.where("CAST(substr(k, 2) AS INT) >= 100")
    collect.idempotent_upsert(collect.file_stream(spark, path, schema), "id", sink, checkpoint, left, "k", 32).awaitTermination()
    touched = {r.b for r in spark.createDataFrame([(1,), (150,), (300,)], "id int").select(collect._bucket("id", 32).alias("b")).collect()}
    buckets = {r.id: r.b for r in spark.range(400).selectExpr("CAST(id AS INT) AS id").select("id", collect._bucket("id", 32).alias("b")).collect()}
    want = {i for i in range(200) if i >= 100 or buckets[i] not in touched} | {1, 300}
    assert {r.id for r in collect.live_ledger(spark, sink, schema, "id").collect()} == want


def test_dedup_within_a_watermark(spark):
    """Repeats inside the delay go, also when they come late; far later ones may stay; rows beyond the watermark are dropped."""
    path = scratch_path(spark, "in")
    batches = [[(1, 0), (2, 10), (1, 20)], [(1, 30), (3, 600)], [(6, 610)], [(2, 595), (4, 5)], [(1, 1200), (5, 1210), (5, 1190)]]
    for rows in batches:
        spark.createDataFrame(rows, "id int, s int").selectExpr("id", "timestamp_seconds(s) AS t", "s").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    for bounded in (False, True):
        sink, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
        stream = collect.file_stream(spark, path, schema, files_per_batch=1)
        collect.stream_dedup(stream, "id", sink, checkpoint, *(("t", "60 seconds") if bounded else ())).awaitTermination()
        found = sorted((r.id, r.s) for r in spark.read.parquet(sink).collect())
        ids = [i for i, _ in found]
        if not bounded:
            assert ids == [1, 2, 3, 4, 5, 6]
        else:       # 1 and 2 come again long after their first rows were forgotten; (4, 5) is later than the watermark
            assert ids == [1, 1, 2, 2, 3, 5, 6] and (1, 1200) in found and (2, 595) in found


def test_observed_metrics_add_up(spark):
    path, schema = source(spark, ROWS)
    sink, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")

    def run():
        stream = collect.file_stream(spark, path, schema, files_per_batch=1)
        return collect.observed_collect(stream, {"n": F.count("*"), "hot": F.count_if(F.col("k") == "hot")}, sink, checkpoint)
    first = run()
    assert len(first) > 1 and sum(r["n"] for r in first) == 300 and sum(r["hot"] for r in first) == 200
    spark.createDataFrame([(999, "hot")], schema).coalesce(1).write.mode("append").parquet(path)
    assert [(r["n"], r["hot"]) for r in run()] == [(1, 1)]
    assert spark.read.parquet(sink).count() == 301


def test_progress_and_dedup_equal_batch(spark):
    path, schema = source(spark, ROWS + ROWS[:40])
    table = spark.read.parquet(path)
    stream = collect.file_stream(spark, path, schema, files_per_batch=1)
    sink, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    collect.stream_progress(stream, ["k"], sink, checkpoint).awaitTermination()
    counted = table.groupBy("k").agg(F.count("*").alias("n"))
    assert collect.latest_progress(spark, sink, counted.schema).exceptAll(counted).count() == 0
    sink, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    collect.stream_dedup(stream, "id", sink, checkpoint).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(300))
