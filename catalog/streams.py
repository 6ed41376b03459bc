"""Incremental collection: each query drains a file stream over the tables, then reads its sink."""

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import table
from sievewright.session import scratch_path
from sievewright.streaming import collect


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return collect.file_stream(spark, sf, schema, f"{name}.parquet"), schema


def _paths(spark, name):
    return scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")


def _in_parts(spark, sf, name, parts, part):
    """Write the table's rows of part 0, 1, ... one after the other, in as many files as tasks read them, and yield after each the stream
    to drain: what is new is one batch."""
    folder, rows = scratch_path(spark, f"{name}-parts"), table(spark, sf, name)
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(folder)
        yield collect.file_stream(spark, folder, rows.schema)


@query("g1_stream_quota", """
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 300""")
def _(spark, sf):
    """Three parts in order of event_id, one a batch."""
    last = table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    sink, checkpoint = _paths(spark, "quota")
    for stream in _in_parts(spark, sf, "events", 3, F.floor(F.col("event_id") * 3 / (last + 1))):
        for _ in range(2):      # the second run finds nothing new
            collect.stream_quota(stream, "event_type", 300, ["event_id"], sink, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink).select("event_id", "user_id", "event_type")


@query("g2_incremental_collect", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    stream, schema = _stream(spark, sf, "orders")
    sink, checkpoint = _paths(spark, "collected")
    for _ in range(2):      # the second run finds nothing new
        collect.incremental_collect(stream, sink, checkpoint).awaitTermination()
    return spark.read.schema(schema).parquet(sink).select("o_orderkey", "o_custkey", "o_totalprice")


@query("g3_idempotent_upsert", "SELECT DISTINCT l_orderkey, l_orderkey % 7 <> 3 OR l_orderkey % 3 = 2 AS present FROM lineitem WHERE l_orderkey % 7 <> 3 OR l_orderkey % 3 = 2")
def _(spark, sf):
    """Three parts by key modulo 3, one a batch; a seventh of the files is lost, found missing by later batches but for those of the last part."""
    sink, first = _paths(spark, "ledger")
    inventory = table(spark, sf, "lineitem").where("l_orderkey % 7 <> 3").select("l_orderkey").distinct().withColumn("length", F.lit(1))
    for stream in _in_parts(spark, sf, "lineitem", 3, F.col("l_orderkey") % 3):
        ids = stream.select("l_orderkey")
        collect.idempotent_upsert(ids, "l_orderkey", sink, first, inventory, "l_orderkey", buckets=4).awaitTermination()
    return collect.live_ledger(spark, sink, ids.schema, "l_orderkey").withColumn("present", F.lit(True))


@query("g4_stream_progress", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, sf):
    stream, _ = _stream(spark, sf, "orders")
    sink, checkpoint = _paths(spark, "progress")
    keys = ["o_orderstatus", "o_orderpriority"]
    collect.stream_progress(stream, keys, sink, checkpoint).awaitTermination()
    schema = stream.select(*keys, F.lit(0).cast("bigint").alias("n")).schema
    return collect.latest_progress(spark, sink, schema)


@query("g4_stream_observed", """
SELECT CAST(o_orderkey % 3 AS BIGINT) AS batch, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, max(o_orderkey) AS last FROM orders GROUP BY 1""")
def _(spark, sf):
    """Metrics of every batch, measured while its rows are written."""
    sink, checkpoint = _paths(spark, "observed")
    metrics = {"n": F.count("*"), "done": F.count_if(F.col("o_orderstatus") == "F"), "last": F.max("o_orderkey")}
    found = [r for stream in _in_parts(spark, sf, "orders", 3, F.col("o_orderkey") % 3)
             for r in collect.observed_collect(stream, metrics, sink, checkpoint)]
    return spark.createDataFrame([(r["batch"], r["n"], r["done"], r["last"]) for r in found], "batch long, n long, done long, last long")


@query("g5_stream_dedup", "SELECT l_partkey, count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem) GROUP BY 1")
def _(spark, sf):
    """Four parts, one a batch, which share most ids."""
    sink, checkpoint = _paths(spark, "unique")
    for stream in _in_parts(spark, sf, "lineitem", 4, F.col("l_orderkey") % 4):
        ids = stream.select("l_partkey")
        collect.stream_dedup(ids, "l_partkey", sink, checkpoint).awaitTermination()
    return spark.read.schema(ids.schema).parquet(sink).groupBy("l_partkey").agg(F.count("*").alias("n"))
