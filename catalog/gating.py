"""Leakage, rule gates, hash verification, fingerprints."""

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import F1, F2, f1, f2, table, with_
from sievewright.operators import counts, gates
from sievewright.sources import files

_PAIR_COUNTS = ("count(*) AS \"groups\", count(*) FILTER (WHERE a AND b) AS train_validation, "
                "count(*) FILTER (WHERE a AND c) AS train_test, count(*) FILTER (WHERE b AND c) AS validation_test")
_FLAGS = "bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c"


@query("d15_split_leakage", with_(F1) + """
, s AS (SELECT source_dataset, split, group_id FROM f1 UNION ALL SELECT '(pooled)', split, group_id FROM f1)
SELECT g.source_dataset AS scope, count(DISTINCT g.group_id) AS "groups",
 (SELECT count(*) FROM (SELECT group_id FROM s x WHERE x.source_dataset = g.source_dataset AND split = 'train' INTERSECT
   SELECT group_id FROM s x WHERE x.source_dataset = g.source_dataset AND split = 'validation')) AS train_validation,
 (SELECT count(*) FROM (SELECT group_id FROM s x WHERE x.source_dataset = g.source_dataset AND split = 'train' INTERSECT
   SELECT group_id FROM s x WHERE x.source_dataset = g.source_dataset AND split = 'test')) AS train_test,
 (SELECT count(*) FROM (SELECT group_id FROM s x WHERE x.source_dataset = g.source_dataset AND split = 'validation' INTERSECT
   SELECT group_id FROM s x WHERE x.source_dataset = g.source_dataset AND split = 'test')) AS validation_test
FROM s g GROUP BY g.source_dataset""")
def _(spark, sf):
    return gates.split_leakage(f1(spark, sf), "group_id")


@query("d15_split_leakage_speakers", with_(F1) + f"""
, v AS (SELECT source_dataset, CASE WHEN order_key % 6 <> 0 THEN speaker_id END AS k, split FROM f1),
 g AS (SELECT source_dataset AS scope, k, {_FLAGS} FROM v WHERE k IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT '(pooled)', k, {_FLAGS} FROM v WHERE k IS NOT NULL GROUP BY 1, 2)
SELECT scope, {_PAIR_COUNTS} FROM g GROUP BY 1""")
def _(spark, sf):
    holes = f1(spark, sf).withColumn("speaker_id", F.expr("CASE WHEN order_key % 6 <> 0 THEN speaker_id END"))
    return gates.split_leakage(holes, "speaker_id", drop_missing=True)


@query("d16_multi_key_leakage", with_(F1) + f"""
, v AS (SELECT u.key, u.value, split FROM f1, LATERAL (VALUES ('speaker_id', speaker_id), ('session_id', session_id), ('source_file_id', source_file_id)) u(key, value)),
 g AS (SELECT key, value, {_FLAGS} FROM v GROUP BY 1, 2)
SELECT key, {_PAIR_COUNTS} FROM g GROUP BY 1""")
def _(spark, sf):
    return gates.multi_key_leakage(f1(spark, sf), ["speaker_id", "session_id", "source_file_id"])


_HOLES = """CASE WHEN source_dataset = '2-HIGH' THEN 'train' WHEN source_dataset = '5-LOW' AND split = 'test' THEN 'validation' ELSE split END"""


@query("d17_empty_splits", with_(F1) + f"""
, v AS (SELECT source_dataset, {_HOLES} AS split FROM f1)
SELECT source_dataset, split FROM (SELECT DISTINCT source_dataset FROM v) CROSS JOIN (VALUES ('train'), ('validation'), ('test')) s(split)
EXCEPT SELECT source_dataset, split FROM v""")
def _(spark, sf):
    return counts.empty_splits(f1(spark, sf).withColumn("split", F.expr(_HOLES)))


@query("d17_empty_splits_audit", with_(F1) + f"""
, v AS (SELECT source_dataset, {_HOLES} AS split FROM f1 WHERE split <> 'validation' OR source_dataset = '2-HIGH')
SELECT source_dataset, split FROM (SELECT DISTINCT source_dataset FROM v) CROSS JOIN (SELECT DISTINCT split FROM v)
EXCEPT SELECT source_dataset, split FROM v""")
def _(spark, sf):
    thin = f1(spark, sf).where("split <> 'validation' OR source_dataset = '2-HIGH'")
    return counts.empty_splits(thin.withColumn("split", F.expr(_HOLES)), skip_absent=True)


# missing ids, one id for many rows, and rows that repeat
_PLANTED = "CASE WHEN doc_key % 9 = 0 THEN NULL WHEN doc_key % 4 = 0 THEN 'one:id' ELSE sample_id END"


@query("d20_fingerprint", with_(F2) + f"""
, planted AS (SELECT {_PLANTED} AS id, sha256 AS h FROM f2 UNION ALL SELECT sample_id, sha256 FROM f2 WHERE doc_key % 5 = 0),
 lines AS (SELECT coalesce(CAST(length(id) AS VARCHAR), '-') || ':' || coalesce(id, '') || ':' || coalesce(h, '') AS line, count(*) AS n FROM planted GROUP BY 1),
 leaf AS (SELECT substr(sha256(line), 1, 5) AS leaf, sum(n) AS n,
  sha256(string_agg(line || ':' || CAST(n AS VARCHAR) || chr(10), '' ORDER BY line)) AS d FROM lines GROUP BY 1),
 branch AS (SELECT substr(leaf, 1, 2) AS branch, sum(n) AS n, sha256(string_agg(leaf || ':' || d || chr(10), '' ORDER BY leaf)) AS d FROM leaf GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(branch || ':' || d || chr(10), '' ORDER BY branch)) AS fingerprint FROM branch""")
def _(spark, sf):
    rows = f2(spark, sf)
    planted = rows.select(F.expr(_PLANTED).alias("id"), "sha256").unionByName(
        rows.where("doc_key % 5 = 0").select(F.col("sample_id").alias("id"), "sha256"))
    return gates.fingerprint(planted, "id", "sha256")


def _verify(spark, sf):
    docs = f2(spark, sf)
    inventory = docs.where("doc_key % 7 <> 0").selectExpr(
        "path", "CASE WHEN doc_key % 11 = 0 THEN 0 ELSE bytes END AS length",
        "CASE WHEN doc_key % 13 = 0 THEN sha2(path, 256) ELSE sha256 END AS sha256")
    stored = docs.withColumn("sha256", F.expr("CASE WHEN doc_key % 26 = 0 THEN '' ELSE sha256 END"))
    return gates.verify_hashes(stored, inventory)


_STATE = """CASE WHEN doc_key % 7 = 0 THEN 'missing' WHEN doc_key % 11 = 0 THEN 'zero_byte'
 WHEN doc_key % 13 = 0 AND doc_key % 26 <> 0 THEN 'mismatch' ELSE 'verified' END"""


@query("d21_verify_hashes", with_(F2) + f"""
SELECT sample_id, {_STATE} AS state, CASE WHEN doc_key % 7 = 0 THEN NULL WHEN doc_key % 13 = 0 THEN sha256(path) ELSE sha256 END AS actual_sha256 FROM f2""")
def _(spark, sf):
    return _verify(spark, sf)


@query("d21_verification_summary", with_(F2) + f"""
SELECT count(*) AS files, count(*) FILTER (WHERE s IN ('verified', 'mismatch')) AS verified, count(*) FILTER (WHERE s = 'missing') AS missing,
 count(*) FILTER (WHERE s = 'zero_byte') AS zero_byte, count(*) FILTER (WHERE s = 'mismatch') AS hash_mismatches FROM (SELECT {_STATE} AS s FROM f2)""")
def _(spark, sf):
    return gates.verification_summary(_verify(spark, sf))


@query("d21_verified_fingerprint", with_(F2) + f"""
, lines AS (SELECT CAST(length(sample_id) AS VARCHAR) || ':' || sample_id || ':' || sha256 AS line, count(*) AS n
            FROM (SELECT sample_id, CASE WHEN doc_key % 13 = 0 THEN sha256(path) ELSE sha256 END AS sha256 FROM f2 WHERE {_STATE} = 'verified') GROUP BY 1),
 leaf AS (SELECT substr(sha256(line), 1, 5) AS leaf, sum(n) AS n, sha256(string_agg(line || ':' || CAST(n AS VARCHAR) || chr(10), '' ORDER BY line)) AS d FROM lines GROUP BY 1),
 branch AS (SELECT substr(leaf, 1, 2) AS branch, sum(n) AS n, sha256(string_agg(leaf || ':' || d || chr(10), '' ORDER BY leaf)) AS d FROM leaf GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(branch || ':' || d || chr(10), '' ORDER BY branch)) AS fingerprint FROM branch""")
def _(spark, sf):
    return gates.verified_fingerprint(_verify(spark, sf))


@query("d21_mismatch_examples", with_(F2) + f"""
SELECT sample_id, 'mismatch' AS state, sha256(path) AS actual_sha256 FROM f2 WHERE {_STATE} = 'mismatch' ORDER BY sample_id LIMIT 10""")
def _(spark, sf):
    return gates.mismatch_examples(_verify(spark, sf))


@query("d22_artifact_hashes", """
SELECT DISTINCT url AS path, strlen(html) AS length, sha256(html) AS sha256
FROM documents JOIN pages ON page_id = doc_id WHERE source <> 'src3'""")
def _(spark, sf):
    """Each document but those of one source lists the page of its number; documents beyond the pages list what is absent."""
    pages = table(spark, sf, "pages")
    listed = table(spark, sf, "documents").where("source <> 'src3'").join(pages, F.col("page_id") == F.col("doc_id"), "left").select(
        F.coalesce("url", F.concat(F.lit("absent/"), F.col("doc_id").cast("string"))).alias("path"), F.col("doc_id").alias("page_id"))
    return gates.artifact_hashes(files.row_inventory(pages, "url", "html", ["page_id"]), listed, ["page_id"])


@query("d36_rule_gate", with_(F1) + """
, a AS (SELECT count(*) AS n, count(*) - count(DISTINCT sample_id) AS d, count(*) - count(DISTINCT speaker_id) AS e, count(*) FILTER (WHERE NOT "exists") AS x,
  bool_and(codec = 'WAV/PCM_16') AS u FROM f1),
 r AS (SELECT r.rule, r.observed, r.expected FROM a, LATERAL (VALUES ('rows > 0', CAST(n > 0 AS VARCHAR), 'true'), ('repeated ids', CAST(d AS VARCHAR), '0'),
  ('repeated speakers', CAST(e AS VARCHAR), '0'), ('missing files', CAST(x AS VARCHAR), '0'), ('one codec', CAST(u AS VARCHAR), 'true')) r(rule, observed, expected))
SELECT rule, observed, expected, observed = expected AS ok, (SELECT bool_and(observed = expected) FROM r) AS frozen FROM r""")
def _(spark, sf):
    return gates.rule_gate(f1(spark, sf), {
        "rows > 0": (F.count("*") > 0, True), "repeated ids": (gates.surplus("sample_id"), 0),
        "repeated speakers": (gates.surplus("speaker_id"), 0), "missing files": (F.count_if(~F.col("exists")), 0),
        "one codec": (gates.equals_set("codec", ["WAV/PCM_16"]), True)})


@query("d37_value_set_equals", with_(F1) + """
SELECT 'processed_codec' AS column_name, count(DISTINCT processed_codec) AS distinct_values, bool_and(processed_codec = 'WAV/PCM_16') AS uniform FROM f1
UNION ALL SELECT 'codec', count(DISTINCT codec), false FROM f1
UNION ALL SELECT 'original_sample_rate', count(DISTINCT original_sample_rate), list_sort(list(DISTINCT original_sample_rate)) = [16000, 24000, 48000] FROM f1""")
def _(spark, sf):
    return gates.value_set_equals(f1(spark, sf), {
        "processed_codec": ["WAV/PCM_16"], "codec": ["WAV/PCM_16", "FLAC/PCM_24"], "original_sample_rate": [16000, 24000, 48000]})


@query("d38_conditional_rules", with_(F1) + """
SELECT count(*) FILTER (WHERE label = 'fake' AND (order_key % 50 = 0 OR order_key % 70 = 1)) AS fake_without_span,
 count(*) FILTER (WHERE label = 'real' AND order_key % 90 = 0) AS real_with_span, count(*) FILTER (WHERE order_key % 200 = 0) AS rows_with_time_labels FROM f1""")
def _(spark, sf):
    spans = f1(spark, sf).selectExpr(
        "label", "CASE WHEN label = 'fake' THEN CASE WHEN order_key % 50 = 0 THEN '0.5' ELSE '0.0' END WHEN order_key % 90 = 0 THEN '0' ELSE ' ' END AS fake_start",
        "CASE WHEN label = 'fake' AND order_key % 70 <> 1 THEN CAST(duration AS STRING) ELSE '' END AS fake_end",
        "CASE WHEN order_key % 200 = 0 THEN 'True' ELSE 'False' END AS has_timestamp_labels")
    return gates.conditional_rules(spans)
