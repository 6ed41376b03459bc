"""One-pass collection that can stop and resume.

What has been seen is keyed state of the stream where Spark has it, else a ledger in hash buckets of which a batch reads those it touches.
Ledgers and progress are tables partitioned by `batch`, overwritten per batch: a batch that is
replayed after a failure replaces its own rows and nothing else.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from sievewright.operators.joins import existing_only, not_processed
from sievewright.operators.running import first_per_group


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The sink so far; empty before the first batch."""
    full = StructType([*schema.fields]).add("batch", LongType())
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException:       # nothing written yet
        return spark.createDataFrame([], full)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _start(stream: DataFrame, handle, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def incremental_collect(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append every new file exactly once."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", sink) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _quota(cap: int, order: list[str], ttl_ms: int | None):
    """Counts the rows that a key has been given and passes on rows, in order inside a batch, while there is room."""
    def take(key, chunks, state):
        now = state.getCurrentProcessingTimeMs() if ttl_ms else 0
        held, last = state.get if state.exists else (0, now)
        if ttl_ms and now - last > ttl_ms:
            held = 0
        room, best = cap - held, None
        for chunk in chunks:        # of a hot key never more than a chunk and the room are held
            if room > 0:
                best = (chunk if best is None else pd.concat([best, chunk])).sort_values(order, kind="stable").head(room)
        given = 0 if best is None else len(best)
        state.update((held + given, now if given else last))
        if given:
            yield best
    return take


def stream_quota(stream: DataFrame, key: str, cap: int, order, sink: str, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Accept rows of a key until it has `cap` of them, across batches and restarts; in the given order inside a batch.

    What a key has been given is keyed state, and the sink is only appended to, never read. A batch's rows of one key
    pass one counter, chunk by chunk, which holds a chunk and the rows there is room for. With `ttl_ms` a count starts
    anew that long after its last accepted row; what is left of an idle key is one pair of numbers.
    """
    counted = stream.groupBy(key).applyInPandasWithState(_quota(cap, list(order), ttl_ms), stream.schema, "held long, last long", "append", "NoTimeout")
    return incremental_collect(counted, sink, checkpoint)


def _bucket(identifier: str, buckets: int):
    return F.pmod(F.xxhash64(identifier), F.lit(buckets)).cast("int")


def _entries(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All lines of a bucketed ledger: entries, and marks of entries that were lost."""
    full = StructType([*schema.fields]).add("lost", BooleanType()).add("batch", LongType()).add("bucket", IntegerType())
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException:       # nothing written yet
        return spark.createDataFrame([], full)


def _live(entries: DataFrame, identifier: str) -> DataFrame:
    """The latest line of every id that is not a mark of loss."""
    latest = first_per_group(entries, [identifier], [F.desc("batch"), "lost"], 1)
    return latest.where(~F.col("lost"))


def touched_entries(spark: SparkSession, sink: str, schema: StructType, buckets: list[int], before: int) -> DataFrame:
    """Lines of some buckets written before a batch; other buckets are not read."""
    return _entries(spark, sink, schema).where(F.col("bucket").isin(buckets) & (F.col("batch") < before))


def idempotent_upsert(stream: DataFrame, identifier: str, sink: str, checkpoint: str,
                      inventory: DataFrame | None = None, path: str = "path", buckets: int = 64) -> StreamingQuery:
    """Add ids the ledger lacks; an entry whose file is gone does not count as done.

    The ledger is cut into hash buckets of ids, and a batch reads only the buckets it touches. Entries there
    whose file the inventory lacks are marked as lost, or replaced if the batch brings them again. Repeats inside a batch are reduced to the
    first row by id and content. A batch overwrites its own folder, so it may be replayed.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        marked = batch.withColumn("bucket", _bucket(identifier, buckets))
        touched = [r["bucket"] for r in marked.select("bucket").distinct().collect()]      # at most `buckets` numbers
        live = _live(touched_entries(spark, sink, schema, touched, batch_id), identifier)
        kept = live if inventory is None else existing_only(live, inventory, path)
        one = first_per_group(not_processed(marked, kept, [identifier]), [identifier], [F.to_json(F.struct(*batch.columns))], 1)
        lines = one.withColumn("lost", F.lit(False))
        if inventory is not None:
            gone = not_processed(not_processed(live, kept, [identifier]), marked, [identifier]).drop("batch").withColumn("lost", F.lit(True))
            lines = lines.unionByName(gone)
        lines.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/batch={batch_id}")

    return _start(stream, handle, checkpoint)


def live_ledger(spark: SparkSession, sink: str, schema: StructType, identifier: str) -> DataFrame:
    """The entries that count as done: the latest of every id, but for lost ones."""
    return _live(_entries(spark, sink, schema), identifier).drop("lost", "batch", "bucket")


def ledger(spark: SparkSession, sink: str, schema: StructType, identifier: str | None = None) -> DataFrame:
    """Rows of a batch table; with an identifier the latest entry per id."""
    table = _table(spark, sink, schema)
    if identifier:
        table = first_per_group(table, [identifier], [F.desc("batch")], 1)
    return table.drop("batch")


def stream_progress(stream: DataFrame, by, sink: str, checkpoint: str) -> StreamingQuery:
    """Running counts, rewritten after every batch."""
    counts = stream.groupBy(*by).agg(F.count("*").alias("n"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, sink, batch_id)

    return counts.writeStream.outputMode("complete").foreachBatch(handle) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_progress(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    table = _table(spark, sink, schema)
    last = table.agg(F.max("batch").alias("b")).scalar()
    return table.where(F.col("batch") == last).drop("batch")


class BatchMetrics(StreamingQueryListener):
    """Collects the metrics that `observe` attached to a stream, one row a batch and query."""

    def __init__(self, name: str):
        self.name, self.rows = name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None and event.progress.numInputRows:
            self.rows.append({"run": str(event.progress.runId), "batch": event.progress.batchId, **found.asDict()})

    def onQueryTerminated(self, event) -> None:
        pass


def observed_collect(stream: DataFrame, metrics: dict, sink: str, checkpoint: str, name: str = "collected") -> list[dict]:
    """Drain the stream into the sink and return its metrics batch by batch, measured while the rows are written.

    Nothing is aggregated by key and no state is kept, so it costs no shuffle. A metric is an aggregate over the rows of a
    batch; counts and sums add up over batches.
    """
    spark = stream.sparkSession
    listener = BatchMetrics(name)
    spark.streams.addListener(listener)
    try:
        query = incremental_collect(stream.observe(name, *[v.alias(k) for k, v in metrics.items()]), sink, checkpoint)
        query.awaitTermination()
        run = str(query.runId)
        wanted = {p["batchId"] for p in query.recentProgress if p["numInputRows"]}
        for _ in range(100):        # events arrive on a queue of their own
            if wanted <= {r["batch"] for r in listener.rows if r["run"] == run}:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    return sorted(({k: v for k, v in r.items() if k != "run"} for r in listener.rows if r["run"] == run), key=lambda r: r["batch"])


def stream_dedup(stream: DataFrame, identifier: str, sink: str, checkpoint: str, event_time: str | None = None,
                 within: str | None = None) -> StreamingQuery:
    """One row per id over the whole stream.

    Without an event time the seen ids are kept as state for good. With `event_time` and `within` (such as "2 hours")
    an id is forgotten once the stream has moved on by that much, so the state is bounded: repeats that far apart in event time
    may both stay, and rows later than that are dropped.
    """
    if event_time is None:
        return incremental_collect(stream.dropDuplicates([identifier]), sink, checkpoint)
    return incremental_collect(stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark([identifier]), sink, checkpoint)
