"""Sources and sinks. Text files are written from the tables first, into the shared folder."""

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import F1, F2, f1, f2, table, with_
from sievewright.operators import conform, counts, currency, joins
from sievewright.session import scratch_path
from sievewright.sources import blocks, files, manifests

TYPED = "sample_id string, duration double, original_sample_rate int, generator string"


@query("a1_read_manifest_strings", with_(F2) + """
SELECT sample_id, source_dataset, transcript, coalesce(label, '') AS label FROM f2""")
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    manifests.write_manifest(f2(spark, sf), path, ["sample_id", "source_dataset", "transcript", "label"], fmt="csv")
    return manifests.read_manifest(spark, path, multiline=True)      # transcripts hold line breaks


@query("a2_read_manifest_typed", with_(F1) + "SELECT sample_id, duration, original_sample_rate, generator FROM f1")
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    manifests.write_manifest(f1(spark, sf), path, ["sample_id", "duration", "original_sample_rate", "generator"], fmt="csv")
    return manifests.read_manifest(spark, path, TYPED, strings=False, multiline=False)


@query("a3_read_tsv", "SELECT CAST(page_id AS VARCHAR) AS client_id, url AS path FROM pages")
def _(spark, sf):
    path = scratch_path(spark, "tsv")
    table(spark, sf, "pages").select(F.col("page_id").alias("client_id"), F.col("url").alias("path")) \
        .write.options(header=True, sep="\t", quote="").csv(path)
    return manifests.read_tsv(spark, path, ["client_id", "path"])


@query("a4_read_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    path = scratch_path(spark, "jsonl")
    talk = table(spark, sf, "conversations")
    talk.write.json(path)
    return manifests.read_jsonl(spark, path, talk.schema)


@query("a5_read_keyed_text", """
SELECT 'k' || CAST(page_id % 60 AS VARCHAR) AS key, arg_max(url, page_id) AS value
FROM pages WHERE page_id % 10 <> 0 GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "keyed")
    line = F.expr("'k' || CAST(page_id % 60 AS STRING) || CASE WHEN page_id % 10 = 0 THEN '  ' ELSE ' ' || url END")
    table(spark, sf, "pages").orderBy("page_id").select(line.alias("value")).write.text(path)
    return manifests.read_keyed_text(spark, path)


@query("a6_read_segments", """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS utt_id, 'r' || CAST(conv_id AS VARCHAR) AS recording_id,
 turn * 2.5::DOUBLE AS start_time, turn * 2.5::DOUBLE + 1.75::DOUBLE AS end_time
FROM conversations WHERE turn % 4 <> 3""")
def _(spark, sf):
    path = scratch_path(spark, "segments")
    line = F.expr("concat_ws(' ', conv_id || '-' || turn, 'r' || conv_id, CAST(turn * 2.5D AS STRING), "
                  "CAST(turn * 2.5D + 1.75D AS STRING), CASE WHEN turn % 4 = 3 THEN 'extra' END)")
    table(spark, sf, "conversations").select(line.alias("value")).write.text(path)
    return manifests.read_segments(spark, path)


@query("a7_scan_columns", "SELECT doc_id, source, lang FROM documents")
def _(spark, sf):
    return manifests.scan_columns(spark, f"{sf}/documents.parquet", ["doc_id", "source", "lang", "no_such_column"])


@query("a8_with_block_position", """
SELECT event_id, 'events.parquet' AS file, event_id // 1000 AS block, event_id % 1000 AS row_in_block FROM events""")
def _(spark, sf):
    return blocks.with_block_position(table(spark, sf, "events"), 1000).select("event_id", "file", "block", "row_in_block")


PROFILE = """p AS (SELECT 'events.parquet' AS file, event_id // 4 AS block, count(*) AS num_rows,
 min(event_type) AS event_type_min, max(event_type) AS event_type_max, min(user_id) AS user_id_min, max(user_id) AS user_id_max,
 min(event_type) = max(event_type) AS pure_event_type, min(user_id) = max(user_id) AS pure_user_id,
 min(event_type) = max(event_type) AND min(user_id) = max(user_id) AS pure FROM events GROUP BY event_id // 4)"""


def _profile(spark, sf):
    return blocks.block_profile(blocks.with_block_position(table(spark, sf, "events"), 4), ["event_type", "user_id"])


@query("a9_block_profile", with_(PROFILE) + "SELECT * FROM p")
def _(spark, sf):
    return _profile(spark, sf)


@query("d48_block_report", with_(PROFILE) + """
SELECT CASE WHEN pure_event_type THEN event_type_min ELSE '(mixed)' END AS event_type, count(*) AS blocks,
 count(*) FILTER (WHERE pure) AS pure_blocks, count(DISTINCT user_id_min) FILTER (WHERE pure) AS entities,
 round(avg(num_rows), 6) AS mean_rows FROM p GROUP BY 1""")
def _(spark, sf):
    return blocks.block_report(_profile(spark, sf), "event_type", "user_id")


@query("a10_file_inventory", "SELECT url AS path, strlen(html) AS length, sha256(html) AS sha256 FROM pages")
def _(spark, sf):
    return files.row_inventory(table(spark, sf, "pages"), "url", "html")


@query("a10_probe_paths", """
SELECT url || gone AS path, gone = '' AS "exists", CASE WHEN gone = '' THEN strlen(html) ELSE 0 END AS file_bytes,
 CASE WHEN gone = '' THEN sha256(html) END AS sha256 FROM pages CROSS JOIN (VALUES ('', ), ('.gone', )) AS v(gone)""")
def _(spark, sf):
    """Pages of one url are files of their own, told apart by the page's number."""
    pages = table(spark, sf, "pages")
    listed = pages.select("page_id", F.explode(F.array("url", F.concat("url", F.lit(".gone")))).alias("path"))
    return files.probe(listed, files.row_inventory(pages, "url", "html", ["page_id"]), by=["page_id"]).drop("page_id")


def _as_files(spark, sf):
    """Every text of benchmark in a file of its own; Spark ends it with a line feed."""
    path = scratch_path(spark, "files")
    table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), "text").repartition("item_id") \
        .write.partitionBy("item_id").text(path)
    return f"{path}/*/*.txt"


def _item():
    return F.regexp_extract("path", "item_id=([^/]*)/", 1).alias("item")


@query("a10_inventory_of_files", "SELECT item_id::VARCHAR AS item, strlen(text) + 1 AS length, sha256(text || chr(10)) AS sha256 FROM benchmark")
def _(spark, sf):
    return files.file_inventory(spark, _as_files(spark, sf)).select(_item(), "length", "sha256")


@query("a10_probe_of_files", """
SELECT item_id::VARCHAR AS item, gone, NOT gone AS "exists", CASE WHEN gone THEN 0 ELSE strlen(text) + 1 END AS length,
 CASE WHEN NOT gone THEN sha256(text || chr(10)) END AS sha256 FROM benchmark CROSS JOIN (VALUES (false), (true)) AS v(gone)""")
def _(spark, sf):
    """Each path is looked up in a task, beside one where no file is."""
    listed = files.file_inventory(spark, _as_files(spark, sf), hashed=False).select(
        F.explode(F.array(F.struct("path", F.lit(False).alias("gone")), F.struct(F.concat("path", F.lit(".gone")).alias("path"), F.lit(True).alias("gone")))).alias("e"))
    probed = files.probe_paths(listed.select("e.path", "e.gone"))
    return probed.select(_item(), "gone", "exists", "length", "sha256")


@query("a10_probe", with_(F2) + """
SELECT sample_id, coalesce(bytes, 0) AS file_bytes, sha256, doc_key % 3 <> 0 AS "exists"
FROM (SELECT sample_id, doc_key, CASE WHEN doc_key % 3 <> 0 THEN bytes END AS bytes,
             CASE WHEN doc_key % 3 <> 0 THEN sha256 END AS sha256 FROM f2)""")
def _(spark, sf):
    manifest = f2(spark, sf)
    inventory = manifest.where("doc_key % 3 <> 0").select("path", F.col("bytes").alias("length"), "sha256")
    return files.probe(manifest.select("sample_id", "path"), inventory).drop("path")


@query("a11_sniff_container", """
SELECT doc_id, ['wav','flac','ogg','mp3','mp3','unknown'][doc_id % 6 + 1] AS container,
 CASE WHEN doc_id % 6 = 0 THEN 16000 + doc_id END AS sample_rate, CASE WHEN doc_id % 6 = 0 THEN 1 + doc_id % 2 END AS channels,
 CASE WHEN doc_id % 6 = 0 THEN 16 END AS bits, doc_id % 6 <> 0 AS extension_lies FROM documents""")
def _(spark, sf):
    little = "lpad(hex({v} % 256), 2, '0') || lpad(hex(({v} div 256) % 256), 2, '0') || lpad(hex(({v} div 65536) % 256), 2, '0') || '00'"
    riff = ("'52494646' || '24000000' || '57415645' || '666D7420' || '10000000' || '0100' || "
            "lpad(hex(1 + doc_id % 2), 2, '0') || '00' || " + little.format(v="(16000 + doc_id)") + " || '00000000' || '0200' || '1000'")
    head = ("CASE doc_id % 6 WHEN 0 THEN " + riff + " WHEN 1 THEN '664C6143' WHEN 2 THEN '4F676753' "
            "WHEN 3 THEN '494433' WHEN 4 THEN 'FFFB' ELSE '00112233' END")
    framed = table(spark, sf, "documents").selectExpr(
        "doc_id", f"concat(unhex({head}), encode(text, 'UTF-8')) AS content", "doc_id || '.wav' AS path")
    found = framed.select("doc_id", "path", files.sniff_container("content").alias("s"))
    return found.select("doc_id", "s.*", files.extension_mismatch("path", F.col("s.container")).alias("extension_lies"))


@query("a12_storage_by_dir", """
WITH s AS (SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS d, length(html) AS b FROM pages)
SELECT CASE WHEN grouping(d) = 1 THEN '(total)' ELSE d END AS directory, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes,
 round(sum(b) / 1e9, 9) AS gigabytes FROM s GROUP BY ROLLUP (d)""")
def _(spark, sf):
    sized = table(spark, sf, "pages").select(F.col("url").alias("path"), F.length("html").cast("bigint").alias("length"))
    return counts.storage_by_dir(sized)


@query("a13_write_manifest", with_(F1) + "SELECT sample_id, label, split, duration FROM f1")
def _(spark, sf):
    path = scratch_path(spark, "written")
    manifests.write_manifest(f1(spark, sf), path, ["sample_id", "label", "split", "duration", "no_such_column"])
    return spark.read.parquet(path)


@query("a14_write_report", with_(F1) + """
SELECT label, '{' || string_agg('"' || source_dataset || '":' || CAST(n AS VARCHAR), ',' ORDER BY source_dataset) || '}' AS document
FROM (SELECT label, source_dataset, count(*) AS n FROM f1 GROUP BY ALL) GROUP BY label""")
def _(spark, sf):
    path = scratch_path(spark, "report")
    counted = f1(spark, sf).groupBy("label", "source_dataset").agg(F.count("*").alias("n"))
    manifests.write_report(counted, path)
    tidy = manifests.read_jsonl(spark, path, counted.schema)
    return manifests.report_document(tidy, "source_dataset", "n", "label")


@query("a15_check_current", with_(F1) + """
SELECT (SELECT count(*) FROM f1 WHERE order_key % 100 = 0 OR order_key % 250 = 7) AS missing,
 (SELECT count(*) FROM f1 WHERE order_key % 100 = 0) AS out_of_date,
 (SELECT count(*) FROM f1 WHERE order_key % 100 = 0 OR order_key % 250 = 7) = 0 AS "current" """)
def _(spark, sf):
    fresh = conform.redact_master(f1(spark, sf), "salt")
    key = F.col("sample_id").cast("bigint")
    published = fresh.where(key % 250 != 7).withColumn(
        "codec", F.when(key % 100 == 0, F.lit("changed")).otherwise(F.col("codec")))
    return joins.check_current(fresh, published)


@query("a15_check_stored", with_(F1) + """
SELECT (SELECT count(*) FROM f1 WHERE order_key % 100 = 0 OR order_key % 250 = 7) AS missing,
 (SELECT count(*) FROM f1 WHERE order_key % 100 = 0) AS out_of_date,
 (SELECT count(*) FROM f1 WHERE order_key % 100 = 0 OR order_key % 250 = 7) = 0 AS "current" """)
def _(spark, sf):
    """The same question by stored digest trees; rows are compared in differing leaves only."""
    fresh = conform.redact_master(f1(spark, sf), "salt")
    key = F.col("sample_id").cast("bigint")
    published = fresh.where(key % 250 != 7).withColumn(
        "codec", F.when(key % 100 == 0, F.lit("changed")).otherwise(F.col("codec")))
    path = scratch_path(spark, "published")
    currency.publish(published, "sample_id", path, digits=1)
    return currency.check_stored(fresh, "sample_id", path, digits=1)
