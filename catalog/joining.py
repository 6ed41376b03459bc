"""Joins between manifests, and set operations."""

from pyspark.sql import functions as F

from catalog import query
from catalog.cleaning import norm
from catalog.fixtures import (DEALT, F1, F2, F4, LICENSED, f1, f2, f4, licensed, table, with_)
from sievewright.operators import derive, joins
from sievewright.session import scratch_path

# conversations as recordings: one segment per turn, some keys left out on each side
SEGMENTS = """seg AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS utt_id, 'r' || CAST(conv_id AS VARCHAR) AS recording_id,
 turn * CAST(2.5 AS DOUBLE) AS start_time, turn * CAST(2.5 AS DOUBLE) + length(role) * CAST(0.25 AS DOUBLE) AS end_time,
 CASE WHEN turn % 5 <> 4 THEN role || CAST(conv_id % 7 AS VARCHAR) END AS speaker_id, CASE WHEN turn % 6 <> 5 THEN text END AS transcript,
 CASE WHEN conv_id % 9 <> 8 THEN 'wav/' || CAST(conv_id AS VARCHAR) || '.wav' END AS wav_name FROM conversations)"""


def kaldi(spark, sf):
    """Segments, texts, speakers and wave names of the conversations."""
    t = table(spark, sf, "conversations").selectExpr(
        "conv_id || '-' || turn AS utt_id", "'r' || conv_id AS recording_id", "turn * 2.5D AS start_time",
        "turn * 2.5D + length(role) * 0.25D AS end_time", "role || (conv_id % 7) AS speaker_id", "text AS transcript",
        "conv_id", "turn", "'wav/' || conv_id || '.wav' AS wav_name")
    return (t.select("utt_id", "recording_id", "start_time", "end_time"),
            t.where("turn % 6 <> 5").select("utt_id", "transcript"),
            t.where("turn % 5 <> 4").select("utt_id", "speaker_id"),
            t.where("conv_id % 9 <> 8").select("recording_id", "wav_name").distinct())


@query("c1_assemble_segments", with_(SEGMENTS) + "SELECT *, end_time - start_time AS duration FROM seg")
def _(spark, sf):
    return joins.assemble_segments(*kaldi(spark, sf))


@query("c1_unmatched_counts", with_(SEGMENTS) + """
SELECT count(*) AS segments, count(*) FILTER (WHERE speaker_id IS NULL) AS no_speaker,
 count(*) FILTER (WHERE transcript IS NULL) AS no_transcript, count(*) FILTER (WHERE wav_name IS NULL) AS no_wav FROM seg""")
def _(spark, sf):
    return joins.unmatched_counts(joins.assemble_segments(*kaldi(spark, sf)))


@query("c2_existing_only", with_(F2) + """
SELECT sample_id FROM f2 WHERE doc_key % 3 <> 0 AND bytes > 500""")
def _(spark, sf):
    manifest = f2(spark, sf)
    inventory = manifest.where("doc_key % 3 <> 0").selectExpr("path", "CASE WHEN bytes > 500 THEN bytes ELSE 0 END AS length")
    return joins.existing_only(manifest, inventory).select("sample_id")


@query("c3_in_catalogue", """
SELECT p.page_id, p.url AS file_name, d.lang FROM pages p JOIN documents d ON d.doc_id = p.page_id * 2
WHERE p.url IN (SELECT url FROM pages WHERE page_id % 3 = 0)""")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    listed = pages.selectExpr("page_id", "url AS file_name", "page_id * 2 AS utt_id")
    repo = pages.where("page_id % 3 = 0").selectExpr("url AS file_name")
    texts = table(spark, sf, "documents").selectExpr("doc_id AS utt_id", "lang")
    return joins.in_catalogue(listed, repo, texts).drop("utt_id")


@query("c4_not_seen", with_(F2) + f"""
SELECT sample_id FROM f2 WHERE split <> 'train' AND {norm('transcript')} NOT IN (SELECT {norm('transcript')} FROM f2 WHERE split = 'train')""")
def _(spark, sf):
    docs = f2(spark, sf)
    return joins.not_seen(docs.where("split <> 'train'"), docs.where("split = 'train'")).select("sample_id")


@query("c5_not_processed", with_(F1) + """
SELECT sample_id, codec FROM f1 WHERE NOT EXISTS (SELECT 1 FROM f1 d WHERE d.order_key % 3 = 0 AND d.sample_id = f1.sample_id AND d.codec = f1.codec)""")
def _(spark, sf):
    todo = f1(spark, sf)
    return joins.not_processed(todo, todo.where("order_key % 3 = 0"), ["sample_id", "codec"]).select("sample_id", "codec")


ASSIGN = "CASE WHEN CAST(speaker_id AS BIGINT) % 3 = 0 THEN 'test' ELSE 'train' END"


@query("c6_apply_assignment", with_(F1) + f"""
SELECT sample_id, CASE WHEN source_dataset IN ('1-URGENT', '2-HIGH') AND CAST(speaker_id AS BIGINT) % 5 <> 0 THEN {ASSIGN} ELSE split END AS split FROM f1""")
def _(spark, sf):
    m = f1(spark, sf)
    assignment = m.where("CAST(speaker_id AS BIGINT) % 5 <> 0").selectExpr("speaker_id", f"{ASSIGN} AS new_split").distinct()
    return joins.apply_assignment(m, assignment, "speaker_id", F.col("source_dataset").isin("1-URGENT", "2-HIGH")) \
        .select("sample_id", "split")


@query("c7_merge_results", with_(F1) + """
SELECT sample_id, duration, CASE WHEN order_key % 9 <> 0 THEN processed_duration END AS processed_duration FROM f1""")
def _(spark, sf):
    m = f1(spark, sf)
    return joins.merge_results(m.select("sample_id", "duration"),
                               m.where("order_key % 9 <> 0").select("sample_id", "processed_duration"), "sample_id")


# a child manifest with planted defects
CHILD = """child AS (SELECT CASE WHEN order_key % 40 = 1 THEN 'lost' || sample_id WHEN order_key % 40 = 2 THEN '2' ELSE sample_id END AS parent_sample_id,
 CASE WHEN order_key % 60 = 3 THEN 'test' ELSE split END AS split, CASE WHEN order_key % 80 = 5 THEN 'test' ELSE 'train' END AS parent_split
 FROM f1 WHERE split = 'train' OR order_key % 100 = 19)"""


@query("c8_check_inheritance", with_(F1, CHILD) + """
SELECT count(*) AS rows, count(*) FILTER (WHERE p.sample_id IS NULL) AS orphans,
 count(*) FILTER (WHERE c.split IS DISTINCT FROM p.split) AS split_differs,
 count(*) FILTER (WHERE parent_split <> 'train') AS wrong_parent_split,
 count(*) FILTER (WHERE p.split IS DISTINCT FROM 'train') AS parent_outside_split,
 count(DISTINCT parent_sample_id) AS parents, count(*) - count(DISTINCT parent_sample_id) AS repeated_parents
FROM child c LEFT JOIN f1 p ON p.sample_id = c.parent_sample_id""")
def _(spark, sf):
    m = f1(spark, sf)
    child = m.where("split = 'train' OR order_key % 100 = 19").selectExpr(
        "CASE WHEN order_key % 40 = 1 THEN 'lost' || sample_id WHEN order_key % 40 = 2 THEN '2' ELSE sample_id END AS parent_sample_id",
        "CASE WHEN order_key % 60 = 3 THEN 'test' ELSE split END AS split",
        "CASE WHEN order_key % 80 = 5 THEN 'test' ELSE 'train' END AS parent_split")
    return joins.check_inheritance(child, m, "train")


@query("c9_expand_conditions", with_(F1) + """
SELECT sample_id, augmentation_condition, augmentation_parameters FROM f1, (VALUES ('mp3', '{"bitrate_kbps":64,"codec":"mp3"}'),
 ('opus', '{"bitrate_kbps":24,"codec":"opus"}'), ('telephone', '{"band_hz":"300-3400","intermediate_rate":8000}'),
 ('lowpass', '{"cutoff_hz":4000}'), ('multi_codec', '{"chain":"mp3_64__opus_24"}')) v(augmentation_condition, augmentation_parameters)
WHERE split = 'test'""")
def _(spark, sf):
    return joins.expand_conditions(f1(spark, sf).where("split = 'test'").select("sample_id"))


@query("c10_namespace_overlap", with_(F1) + """
, a AS (SELECT speaker_id, min(gender) AS g FROM f1 WHERE source_dataset = '1-URGENT' GROUP BY 1),
 b AS (SELECT speaker_id, min(upstream_dataset) AS x, min(gender) AS g FROM f1 WHERE source_dataset = '5-LOW' GROUP BY 1),
 s AS (SELECT speaker_id, count(DISTINCT split) AS k FROM f1 WHERE source_dataset IN ('1-URGENT', '5-LOW') GROUP BY 1)
SELECT (SELECT count(*) FROM a) AS ids_a, (SELECT count(*) FROM b) AS ids_b, count(*) AS shared,
 count(*) FILTER (WHERE a.g = b.g) AS attribute_agrees, count(*) FILTER (WHERE s.k > 1) AS straddling
FROM a JOIN b USING (speaker_id) JOIN s USING (speaker_id)""")
def _(spark, sf):
    return joins.namespace_overlap(f1(spark, sf), "1-URGENT", "5-LOW", "speaker_id", "gender")


@query("d43_chance_probability", with_(F1) + """
, b AS (SELECT speaker_id, bool_or(gender = 'Male') AS has FROM f1 WHERE source_dataset = '5-LOW' GROUP BY 1),
 c AS (SELECT count(*) AS n, count(*) FILTER (WHERE has) AS m,
  count(*) FILTER (WHERE speaker_id IN (SELECT speaker_id FROM f1 WHERE source_dataset = '1-URGENT')) AS k FROM b)
SELECT n, m, k, round(k * log10(m / n), 6) AS log10_probability FROM c""")
def _(spark, sf):
    return joins.chance_probability(f1(spark, sf), "1-URGENT", "5-LOW", "speaker_id", "gender", "Male")


@query("c11_cross_label_text", with_(F2) + f"""
, t AS (SELECT {norm('transcript')} AS text_key, CASE WHEN doc_key % 2 = 0 THEN 'real' ELSE 'fake' END AS label, split FROM f2)
SELECT sha256(text_key) AS text_sha256, count(*) FILTER (WHERE label = 'real') AS real_rows, count(*) FILTER (WHERE label = 'fake') AS fake_rows,
 (SELECT count(*) FROM t a JOIN t b ON a.text_key = b.text_key AND a.label = 'real' AND b.label = 'fake' AND a.split <> b.split
  WHERE a.text_key = t.text_key) AS cross_split_pairs
FROM t GROUP BY text_key HAVING count(*) FILTER (WHERE label = 'real') > 0 AND count(*) FILTER (WHERE label = 'fake') > 0""")
def _(spark, sf):
    labelled = f2(spark, sf).withColumn("label", F.expr("CASE WHEN doc_key % 2 = 0 THEN 'real' ELSE 'fake' END"))
    return joins.cross_label_text(labelled)


@query("c11_cross_label_names", with_(F1) + """
, t AS (SELECT lower(transcript) AS text_key, label, split, count(*) AS n FROM f1 GROUP BY ALL),
 p AS (SELECT a.text_key, sum(a.n * b.n) AS pairs FROM t a JOIN t b USING (text_key)
       WHERE a.label = 'real' AND b.label = 'fake' AND a.split <> b.split GROUP BY 1)
SELECT sha256(text_key) AS text_sha256, CAST(sum(n) FILTER (WHERE label = 'real') AS BIGINT) AS real_rows, CAST(sum(n) FILTER (WHERE label = 'fake') AS BIGINT) AS fake_rows,
 CAST(coalesce(any_value(pairs), 0) AS BIGINT) AS cross_split_pairs FROM t LEFT JOIN p USING (text_key) GROUP BY text_key
HAVING count(DISTINCT label) = 2""")
def _(spark, sf):
    return joins.cross_label_text(f1(spark, sf))


# the benchmark, plus documents of the held-out kind, as external set
EXTERNAL = f"""ext AS (SELECT text FROM benchmark UNION ALL SELECT text FROM documents WHERE doc_id % 4 = 1),
 dev AS (SELECT * FROM f2 WHERE doc_key % 4 <> 1)"""


@query("c12_external_overlap", with_(F2, EXTERNAL) + f"""
, e AS (SELECT DISTINCT {norm('text')} AS k FROM ext)
SELECT count(*) AS external_texts, count(*) FILTER (WHERE k IN (SELECT {norm('transcript')} FROM dev WHERE split IN ('train', 'validation'))) AS in_train_validation,
 count(*) FILTER (WHERE k IN (SELECT {norm('transcript')} FROM dev)) AS in_development FROM e""")
def _(spark, sf):
    external = table(spark, sf, "benchmark").select("text").unionByName(
        table(spark, sf, "documents").where("doc_id % 4 = 1").select("text"))
    return joins.external_overlap(f2(spark, sf).where("doc_key % 4 <> 1"), external, "transcript", "text")


@query("c13_id_collision", with_(F1) + """
, other AS (SELECT sample_id, CASE WHEN order_key % 3 = 0 THEN processed_sha256 ELSE sha256 END AS sha256,
  CASE WHEN order_key % 7 = 0 THEN processed_file_path ELSE file_path END AS file_path FROM f1 WHERE order_key % 2 = 0)
SELECT a.sample_id, a.sha256 <> b.sha256 AS content_differs, a.file_path <> b.file_path AS path_differs
FROM f1 a JOIN other b USING (sample_id) WHERE a.sha256 <> b.sha256 OR a.file_path <> b.file_path""")
def _(spark, sf):
    m = f1(spark, sf)
    other = m.where("order_key % 2 = 0").selectExpr(
        "sample_id", "CASE WHEN order_key % 3 = 0 THEN processed_sha256 ELSE sha256 END AS sha256",
        "CASE WHEN order_key % 7 = 0 THEN processed_file_path ELSE file_path END AS file_path")
    return joins.id_collision(m, other)


@query("c14_noop_derivatives", with_(F1, LICENSED, DEALT) + """
SELECT c AS augmentation_condition, count(*) AS n, count(*) FILTER (WHERE same) AS noops,
 count(*) FILTER (WHERE same AND label = 'real') AS noops_real, count(*) FILTER (WHERE same AND label = 'fake') AS noops_fake,
 round(count(*) FILTER (WHERE same) / count(*), 6) AS noop_rate
FROM (SELECT *, (c = 'mild_clipping' AND order_key % 6 = 0) OR (c = 'telephone' AND order_key % 90 = 0) AS same FROM dealt) GROUP BY 1""")
def _(spark, sf):
    m = licensed(spark, sf)
    child = derive.plan_train(m)
    key = F.col("parent_sample_id").cast("bigint")
    same = ((F.col("augmentation_condition") == "mild_clipping") & (key % 6 == 0)) | (
        (F.col("augmentation_condition") == "telephone") & (key % 90 == 0))
    hashed = child.withColumn("sha256", F.sha2(F.when(same, F.col("parent_sample_id")).otherwise(F.col("augmentation_id")), 256))
    return joins.noop_derivatives(hashed, m)


COVER = """man AS (SELECT path FROM f2 WHERE doc_key % 5 <> 0 UNION ALL SELECT path FROM f2 WHERE doc_key % 50 = 1),
 inv AS (SELECT path FROM f2 WHERE doc_key % 3 <> 0)"""


@query("c15_coverage", with_(F2, COVER) + """
, r AS (SELECT path, count(*) AS refs FROM man GROUP BY 1)
SELECT count(refs) AS referenced, count(i) AS on_disk, count(*) FILTER (WHERE refs IS NOT NULL AND i IS NOT NULL) AS matched,
 count(*) FILTER (WHERE i IS NULL) AS referenced_but_missing, count(*) FILTER (WHERE refs IS NULL) AS on_disk_but_unlabelled,
 count(*) FILTER (WHERE refs > 1) AS referenced_twice
FROM r FULL OUTER JOIN (SELECT path, true AS i FROM inv) USING (path)""")
def _(spark, sf):
    docs = f2(spark, sf)
    manifest = docs.where("doc_key % 5 <> 0").select("path").unionByName(docs.where("doc_key % 50 = 1").select("path"))
    return joins.coverage(manifest, docs.where("doc_key % 3 <> 0"))


DUPLICATES = """g AS (SELECT sha256 AS content_sha256, count(*) AS copies, count(DISTINCT source_dataset) AS collections,
 min(source_dataset) AS first_collection, max(source_dataset) AS last_collection, count(*) - 1 AS redundant
 FROM f2 GROUP BY 1 HAVING count(*) > 1)"""


def _duplicates(spark, sf):
    files = f2(spark, sf).select(F.col("bytes").alias("length"), "transcript", F.col("source_dataset").alias("collection"))
    return joins.content_duplicates(files, F.sha2("transcript", 256))


@query("c16_content_duplicates", with_(F2, DUPLICATES) + "SELECT * FROM g")
def _(spark, sf):
    return _duplicates(spark, sf)


@query("c16_duplicate_summary", with_(F2, DUPLICATES) + """
SELECT first_collection, last_collection, count(*) AS duplicate_groups, CAST(sum(copies) AS BIGINT) AS files,
 CAST(sum(redundant) AS BIGINT) AS redundant_copies FROM g GROUP BY 1, 2""")
def _(spark, sf):
    return joins.duplicate_summary(_duplicates(spark, sf))


# every recording cut in spans of 12 of each 20 frames, the last ones past its end
SPANS = """spans AS (SELECT recording, recording || '-' || CAST(k AS VARCHAR) AS segment_id, k * 2.0 + 0.3 AS start_time, k * 2.0 + 1.5 AS end_time
 FROM (SELECT recording, unnest(range(count(*) // 20 + 3)) AS k FROM f4 GROUP BY recording))"""


def _spans(frames):
    sized = frames.groupBy("recording").agg(F.count("*").alias("n"))
    listed = sized.select("recording", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("n div 20 + 2"))).alias("k"))
    return listed.selectExpr("recording", "recording || '-' || k AS segment_id", "k * 2.0D + 0.3D AS start_time",
                             "k * 2.0D + 1.5D AS end_time", "10 AS rate")


@query("c17_slice_intervals", with_(F4, SPANS) + """
SELECT segment_id, s.recording, frame, value FROM spans s JOIN f4 ON f4.recording = s.recording
 AND frame >= round(start_time * 10) AND frame < round(end_time * 10)""")
def _(spark, sf):
    frames = f4(spark, sf)
    return joins.slice_intervals(_spans(frames), frames, 32).select("segment_id", "recording", "frame", "value")


@query("c17_slice_report", with_(F4, SPANS) + """
SELECT segment_id, count(frame) AS frames, count(frame) = 0 AS empty_span FROM spans s LEFT JOIN f4 ON f4.recording = s.recording
 AND frame >= round(start_time * 10) AND frame < round(end_time * 10) GROUP BY 1""")
def _(spark, sf):
    frames = f4(spark, sf)
    spans = _spans(frames)
    return joins.slice_report(spans, joins.slice_intervals(spans, frames, 32))


TARGETS = """rec AS (SELECT event_id // 100 AS block, event_id % 100 AS row_in_group, 'r' || CAST(event_id - event_id % 2 AS VARCHAR) AS row_id, event_id FROM events),
 tgt AS (SELECT event_id // 100 AS block, (event_id % 100 + CASE WHEN event_id % 30 = 0 THEN 7 WHEN event_id % 30 = 15 THEN 95 ELSE 0 END) AS row_in_group,
  CASE WHEN event_id % 50 = 1 THEN 'nowhere' ELSE 'r' || CAST(event_id - event_id % 2 AS VARCHAR) END AS row_id, event_id AS target FROM events)"""


@query("c18_locate_with_guard", with_(TARGETS) + """
, f AS (SELECT block, row_id, arg_min(event_id, row_in_group) AS event_id FROM rec GROUP BY 1, 2)
SELECT target, 'events' AS file, t.block, t.row_in_group, t.row_id, a.row_id = t.row_id AS by_position,
 CASE WHEN a.row_id = t.row_id THEN a.event_id ELSE f.event_id END AS event_id
FROM tgt t JOIN rec a ON a.block = t.block AND a.row_in_group = t.row_in_group
LEFT JOIN f ON f.block = t.block AND f.row_id = t.row_id WHERE a.row_id = t.row_id OR f.event_id IS NOT NULL""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id").withColumn("file", F.lit("events"))
    records = e.selectExpr("file", "event_id div 100 AS block", "event_id % 100 AS row_in_group",
                           "'r' || (event_id - event_id % 2) AS row_id", "event_id")
    targets = e.selectExpr("file", "event_id div 100 AS block",
                           "event_id % 100 + CASE WHEN event_id % 30 = 0 THEN 7 WHEN event_id % 30 = 15 THEN 95 ELSE 0 END AS row_in_group",
                           "CASE WHEN event_id % 50 = 1 THEN 'nowhere' ELSE 'r' || (event_id - event_id % 2) END AS row_id", "event_id AS target")
    return joins.locate_with_guard(targets, records)


@query("c19_shared_prefixes", """
SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 15, '8') AS prefix FROM orders WHERE o_orderpriority = '1-URGENT'
INTERSECT SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 15, '8') FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderkey % 3 <> 0""")
def _(spark, sf):
    ids = table(spark, sf, "orders").selectExpr(
        "o_orderpriority AS p", "CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN 'none' "
        "ELSE lpad(CAST(o_custkey AS STRING), 15, '8') || '-' || o_orderkey || '-m.wav' END AS file_id")
    return joins.shared_prefixes(ids.where("p = '1-URGENT'"), ids.where("p = '5-LOW'"), "file_id", "file_id", r"^(\d{15})-\d+-[mf]")


@query("c20_leaky_groups", with_(F1) + """
SELECT group_id, count(DISTINCT split) AS splits, count(*) AS n FROM f1 GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def _(spark, sf):
    return joins.leaky_groups(f1(spark, sf), "group_id")


# ---- set operations ----

@query("f1_union_sources", with_(F1, F2) + """
SELECT sample_id, source_dataset, label, codec, CAST(NULL AS BIGINT) AS bytes FROM f1
UNION ALL SELECT sample_id, source_dataset, label, NULL, bytes FROM f2""")
def _(spark, sf):
    return joins.union_sources([f1(spark, sf).select("sample_id", "source_dataset", "label", "codec"),
                                f2(spark, sf).select("sample_id", "source_dataset", "label", "bytes")])


@query("f2_key_intersection", with_(F1) + """
SELECT count(*) AS shared FROM (SELECT speaker_id FROM f1 WHERE split = 'train' INTERSECT SELECT speaker_id FROM f1 WHERE split = 'test')""")
def _(spark, sf):
    m = f1(spark, sf)
    return joins.key_intersection(m.where("split = 'train'"), m.where("split = 'test'"), "speaker_id", "speaker_id")


@query("f3_is_subset", with_(F1, CHILD) + """
SELECT count(*) AS outside, count(*) = 0 AS subset FROM (SELECT DISTINCT parent_sample_id FROM child
 WHERE parent_sample_id NOT IN (SELECT sample_id FROM f1 WHERE split = 'train'))""")
def _(spark, sf):
    m = f1(spark, sf)
    child = m.where("split = 'train' OR order_key % 100 = 19").selectExpr(
        "CASE WHEN order_key % 40 = 1 THEN 'lost' || sample_id WHEN order_key % 40 = 2 THEN '2' ELSE sample_id END AS parent_sample_id")
    return joins.is_subset(child, m.where("split = 'train'"), "parent_sample_id", "sample_id")


@query("f4_conditional_purge", with_(F1) + """
SELECT sample_id, label FROM f1 WHERE NOT (label = 'real' AND EXISTS (SELECT 1 FROM f1 x WHERE x.label = 'real' AND x.upstream_dataset = 'corpus_b'))""")
def _(spark, sf):
    return joins.conditional_purge(f1(spark, sf), "real", ["corpus_b"]).select("sample_id", "label")


@query("f5_replace_partition", with_(F1) + """
SELECT sample_id, source_dataset, label FROM f1 WHERE source_dataset <> '5-LOW'
UNION ALL SELECT 'new_' || sample_id, source_dataset, 'fake' FROM f1 WHERE source_dataset = '5-LOW' AND order_key % 2 = 0""")
def _(spark, sf):
    m = f1(spark, sf).select("sample_id", "source_dataset", "label", "order_key")
    new = m.where("source_dataset = '5-LOW' AND order_key % 2 = 0").selectExpr(
        "'new_' || sample_id AS sample_id", "source_dataset", "'fake' AS label")
    return joins.replace_partition(m.drop("order_key"), new, "source_dataset", "5-LOW")


@query("f5_overwrite_partitions", with_(F1) + """
SELECT sample_id, source_dataset, label FROM f1 WHERE source_dataset <> '5-LOW'
UNION ALL SELECT 'new_' || sample_id, source_dataset, 'fake' FROM f1 WHERE source_dataset = '5-LOW' AND order_key % 2 = 0""")
def _(spark, sf):
    """The same replacement in a stored table, whose other partitions are not rewritten."""
    path = scratch_path(spark, "partitioned")
    m = f1(spark, sf).select("sample_id", "source_dataset", "label", "order_key")
    m.drop("order_key").repartition("source_dataset").write.partitionBy("source_dataset").parquet(path)
    joins.overwrite_partitions(m.where("source_dataset = '5-LOW' AND order_key % 2 = 0").selectExpr(
        "'new_' || sample_id AS sample_id", "source_dataset", "'fake' AS label"), path, "source_dataset")
    return spark.read.schema(m.drop("order_key").schema).parquet(path).select("sample_id", "source_dataset", "label")
