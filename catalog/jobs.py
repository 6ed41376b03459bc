"""The end-to-end jobs. Their reports are tidy tables of text values."""

from functools import reduce

from pyspark.sql import functions as F

from catalog import query
from catalog.audits import _FEATURED, shortcut_sql
from catalog.cleaning import norm
from catalog.fixtures import (AUGMENTED, F1, F2, F5, LICENSED, LICENSES_SQL, ROBUSTNESS, f1, f2, f5, licensed,
                              licenses, table, with_, with_audio)
from catalog.joining import SEGMENTS, kaldi
from catalog.splitting import _PERCENT, greedy_sql
from sievewright.functions import clean
from sievewright.operators import derive, signals
from sievewright.plans import jobs


def scope(*columns: str) -> str:
    return "concat_ws(' | ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns) + ")" if columns else "'all'"


def lines(metric: str, rows: str, by: tuple, items: dict) -> str:
    """SQL for report lines: each item is a text or a number rounded to six decimals."""
    listed = ", ".join(f"('{name}', CAST({expr} AS VARCHAR))" for name, expr in items.items())
    return f"SELECT '{metric}' AS metric, {scope(*by)} AS scope, u.item, u.value FROM ({rows}) z, LATERAL (VALUES {listed}) u(item, value)"


def same(*names: str) -> dict:
    return {n: f'z."{n}"' for n in names}


def report(*parts: str) -> str:
    return " UNION ALL ".join(parts)


_MAPPED = {c: c for c in ("sample_id", "file_path", "language", "language_type", "label", "source_dataset", "generator", "voice",
                          "session_id", "source_file_id", "gender", "transcript", "split")} | {
    "declared_duration": "duration", "declared_sample_rate": "original_sample_rate", "declared_codec": "codec"}


@query("i1_build_master", with_(F1, LICENSES_SQL) + """
SELECT f1.sample_id, f1.file_path, CAST(NULL AS VARCHAR) AS language, language_type, label, source_dataset, generator, voice, speaker_id,
 CASE WHEN source_dataset < '3' THEN speaker_id END AS target_speaker_id, CASE WHEN source_dataset < '3' THEN session_id END AS source_speaker_id,
 session_id, source_file_id, gender, split, CASE WHEN ok THEN processed_duration END AS duration,
 CASE WHEN ok THEN processed_codec END AS codec, CASE WHEN ok THEN channels END AS channels, CASE WHEN ok THEN file_bytes ELSE 0 END AS file_bytes,
 CASE WHEN ok THEN sha256 END AS sha256, transcript, coalesce(license, 'unknown') AS license, coalesce(license_status, 'UNVERIFIED') AS license_status,
 duration AS declared_duration, original_sample_rate AS declared_sample_rate, codec AS declared_codec, ok AS "exists",
 CASE WHEN ok THEN probe_error END AS probe_error, CASE WHEN source_dataset < '3' THEN 'metadata/first.csv' ELSE 'metadata/second.csv' END AS origin_metadata_file
FROM (SELECT *, "exists" AS ok FROM f1) f1 LEFT JOIN lic USING (source_dataset)""")
def _(spark, sf):
    m = f1(spark, sf)
    first = m.where("source_dataset < '3'").withColumns({"target_speaker_id": F.col("speaker_id"), "source_speaker_id": F.col("session_id")})
    inventory = m.where(F.col("exists")).select(
        F.col("file_path").alias("path"), F.col("file_bytes").alias("length"), "sha256", F.col("processed_duration").alias("duration"),
        F.col("processed_codec").alias("codec"), "channels", "probe_error")
    return jobs.build_master({"first": first, "second": m.where("source_dataset >= '3'")}, _MAPPED, inventory, licenses(spark))


_G = "language_type, label, source_dataset"


@query("i2_audit_master", with_(F1, LICENSED) + report(
    lines("integrity", """SELECT count(*) AS rows, count(*) FILTER (WHERE NOT "exists") AS missing_files, count(*) FILTER (WHERE file_bytes = 0) AS zero_byte,
      count(probe_error) AS probe_errors, CAST(sum(file_bytes) AS BIGINT) AS total_bytes, count(DISTINCT sha256) AS unique_sha256 FROM m""", (),
          same("rows", "missing_files", "zero_byte", "probe_errors", "total_bytes", "unique_sha256")),
    *[lines("duplicates", f"SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS members, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM "
            f"(SELECT count(*) AS n FROM m WHERE {'sha256 IS NOT NULL' if c == 'sha256' else 'true'} GROUP BY {c} HAVING count(*) > 1)", (f"'{c}'",),
            same("members", "surplus")) for c in ("sample_id", "file_path", "sha256")],
    lines("distribution", f"SELECT {_G}, count(*) AS n FROM m GROUP BY ALL", ("'language_type+label+source_dataset'", "label", "language_type", "source_dataset", "''"), same("n")),
    lines("distribution", "SELECT split, count(*) AS n FROM m GROUP BY ALL", ("'split'", "''", "''", "''", "split"), same("n")),
    lines("distribution", "SELECT label, split, count(*) AS n FROM m GROUP BY ALL", ("'label+split'", "label", "''", "''", "split"), same("n")),
    lines("reconcile", f"""SELECT {_G}, count(*) AS actual, count(*) + CASE WHEN label = 'real' THEN 1 ELSE 0 END AS expected, label <> 'real' AS matches FROM m GROUP BY {_G}""",
          ("language_type", "label", "source_dataset"), same("expected", "actual", "matches")),
    lines("duration", f"""SELECT {_G}, n, (2 * s + 3600000) // 7200000 / 1e6::DOUBLE AS hours, round(min_s, 6) AS min_s, CAST(CAST(CAST(median_s AS DECIMAL(28,9)) AS DECIMAL(28,6)) AS DOUBLE) AS median_s,
      (2 * s + 1000 * n) // (2000 * n) / 1e6::DOUBLE AS mean_s, round(max_s, 6) AS max_s FROM (SELECT {_G}, count(*)::HUGEINT AS n, sum(CAST(round(duration * 1e9::DOUBLE) AS HUGEINT)) AS s,
       min(duration) AS min_s, median(duration) AS median_s, max(duration) AS max_s FROM m GROUP BY {_G})""", ("language_type", "label", "source_dataset"),
          same("n", "hours", "min_s", "median_s", "mean_s", "max_s")),
    lines("short", "SELECT count(*) FILTER (WHERE duration < 2) AS under_2, count(*) FILTER (WHERE duration < 1) AS under_1 FROM m", (), same("under_2", "under_1")),
    lines("declared", """SELECT count(*) FILTER (WHERE declared_sample_rate IS NOT NULL AND TRY_CAST(declared_sample_rate AS DOUBLE) IS DISTINCT FROM original_sample_rate) AS rate_mismatch,
      count(*) FILTER (WHERE abs(declared_duration - duration) > 0.05) AS duration_mismatch FROM m""", (), same("rate_mismatch", "duration_mismatch")),
    lines("speakers", "SELECT source_dataset, count(*) AS rows_with_entity, count(DISTINCT speaker_id) AS unique_entities FROM m GROUP BY 1", ("source_dataset",),
          same("rows_with_entity", "unique_entities")),
    lines("leakage", """SELECT s, count(*) FILTER (WHERE a AND b) AS train_validation, count(*) FILTER (WHERE a AND c) AS train_test, count(*) FILTER (WHERE b AND c) AS validation_test
      FROM (SELECT s, speaker_id, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c
        FROM m, LATERAL (VALUES (source_dataset), ('(pooled)')) v(s) GROUP BY 1, 2) GROUP BY 1""", ("s",), same("train_validation", "train_test", "validation_test")),
    lines("separator", """SELECT l, f, count(*) FILTER (WHERE r AND k) AS shared_values, CAST(coalesce(sum(n) FILTER (WHERE r AND k), 0) AS BIGINT) AS ambiguous_rows,
       count(*) FILTER (WHERE r AND k) = 0 AS perfect FROM (SELECT language_type AS l, f, v, bool_or(label = 'real') AS r, bool_or(label = 'fake') AS k, count(*) AS n
        FROM m, LATERAL (VALUES ('codec', codec), ('original_sample_rate', CAST(original_sample_rate AS VARCHAR)), ('channels', CAST(channels AS VARCHAR))) u(f, v) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
          ("l", "f"), same("shared_values", "ambiguous_rows", "perfect")),
    *[lines("values", f"SELECT {c}, count(*) AS n FROM m WHERE {c} IS NOT NULL GROUP BY 1", (f"'{c}'", c), same("n")) for c in ("codec", "channels")],
    lines("split by source", """SELECT source_dataset, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'validation') AS n_validation,
      count(*) FILTER (WHERE split = 'test') AS n_test FROM m GROUP BY 1""", ("source_dataset",), same("n_train", "n_validation", "n_test")),
    lines("licence", "SELECT license_status, count(*) AS clips FROM m GROUP BY 1", ("license_status",), same("clips")),
    lines("licence by source", "SELECT source_dataset, license, license_status, count(*) AS clips FROM m GROUP BY ALL",
          ("source_dataset", "license", "license_status"), same("clips"))))
def _(spark, sf):
    m = licensed(spark, sf)
    expected = m.groupBy(*jobs.GROUP).agg((F.count("*") + F.max((F.col("label") == "real").cast("int"))).alias("expected"))
    return jobs.audit_master(m, expected)


REPAIRED = "WITH RECURSIVE " + F1 + ", one AS (SELECT * FROM f1 WHERE source_dataset = '3-MEDIUM')" + greedy_sql("one", "speaker_id", "''", _PERCENT) + f""",
 rep AS (SELECT sample_id, source_dataset, source_dataset || '::' || CASE WHEN source_dataset = '5-LOW' THEN {norm('transcript')} ELSE speaker_id END AS group_id,
  CASE WHEN lower(trim(gender)) = 'male' THEN 'male' WHEN lower(trim(gender)) LIKE 'female%' THEN 'female' ELSE 'unknown' END AS gender_normalized,
  CASE WHEN source_dataset = '3-MEDIUM' THEN f.split ELSE f1.split END AS split FROM f1 LEFT JOIN f ON f.k = f1.speaker_id)"""


def _repaired(spark, sf):
    return jobs.repair_splits(f1(spark, sf), "3-MEDIUM", {"5-LOW": "transcript"}, "speaker_id")


@query("i3_repair_splits", REPAIRED + " SELECT sample_id, group_id, gender_normalized, split FROM rep")
def _(spark, sf):
    return _repaired(spark, sf).select("sample_id", "group_id", "gender_normalized", "split")


@query("i3_repair_report", REPAIRED + report(
    " " + lines("rows", """SELECT source_dataset, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'validation') AS n_validation,
      count(*) FILTER (WHERE split = 'test') AS n_test FROM rep GROUP BY 1""", ("source_dataset",), same("n_train", "n_validation", "n_test")),
    lines("leakage", """SELECT s, count(*) FILTER (WHERE a AND b) AS train_validation, count(*) FILTER (WHERE a AND c) AS train_test, count(*) FILTER (WHERE b AND c) AS validation_test
      FROM (SELECT s, group_id, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c
        FROM rep, LATERAL (VALUES (source_dataset), ('(pooled)')) v(s) GROUP BY 1, 2) GROUP BY 1""", ("s",), same("train_validation", "train_test", "validation_test"))))
def _(spark, sf):
    return jobs.repair_report(_repaired(spark, sf))


_DRIFT = """count(*) AS n, count(*) FILTER (WHERE x > 0.05) AS over_tolerance, round(max(x), 6) AS max_delta, round(avg(x), 6) AS mean_delta, round(median(x), 6) AS median_delta"""
_CHANGES = ("n", "over_tolerance", "max_delta", "mean_delta", "median_delta")


@query("i4_audit_canonical", with_(F1, "c AS (SELECT *, abs(processed_duration - duration) AS x FROM f1 WHERE order_key % 10 <> 3)") + report(
    lines("processing", """SELECT source_dataset, count(*) AS rows, count(*) FILTER (WHERE order_key % 10 <> 3) AS processed,
      count(*) FILTER (WHERE order_key % 10 = 3) AS unprocessed FROM f1 GROUP BY 1""", ("source_dataset",), same("rows", "processed", "unprocessed")),
    lines("integrity", """SELECT count(*) AS rows, count(*) FILTER (WHERE NOT "exists") AS missing_files, count(*) FILTER (WHERE file_bytes = 0) AS zero_byte,
      count(probe_error) AS probe_errors FROM c""", (), same("rows", "missing_files", "zero_byte", "probe_errors")),
    *[lines("uniform", f"SELECT count(DISTINCT {c}) AS distinct_values, count(*) = count(*) FILTER (WHERE CAST({c} AS VARCHAR) = '{v}') AS uniform FROM c",
            (f"'{c}'",), same("distinct_values", "uniform")) for c, v in (("processed_sample_rate", "16000"), ("processed_channels", "1"), ("processed_codec", "WAV/PCM_16"))],
    lines("codec", """SELECT source_dataset, v, CAST(sum(b) AS BIGINT) AS b, CAST(sum(a) AS BIGINT) AS a FROM (SELECT source_dataset, codec AS v, 1 AS b, 0 AS a FROM c
      UNION ALL SELECT source_dataset, processed_codec, 0, 1 FROM c) GROUP BY 1, 2""", ("source_dataset", "v"), {"before": "z.b", "after": "z.a"}),
    lines("sample rate", """SELECT source_dataset, v, CAST(sum(b) AS BIGINT) AS b, CAST(sum(a) AS BIGINT) AS a FROM (SELECT source_dataset, original_sample_rate AS v, 1 AS b, 0 AS a FROM c
      UNION ALL SELECT source_dataset, processed_sample_rate, 0, 1 FROM c) GROUP BY 1, 2""", ("source_dataset", "v"), {"before": "z.b", "after": "z.a"}),
    lines("drift", f"SELECT {_DRIFT} FROM c", (), same(*_CHANGES)),
    lines("drift by source", f"SELECT source_dataset, {_DRIFT} FROM c GROUP BY 1", ("source_dataset",), same(*_CHANGES)),
    lines("duration", """SELECT split, count(*) AS n, round(sum(processed_duration) / 3600, 6) AS hours, round(median(processed_duration), 6) AS median_s FROM c GROUP BY 1""",
          ("split",), same("n", "hours", "median_s")),
    lines("duplicates", """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS members, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus
      FROM (SELECT count(*) AS n FROM c GROUP BY processed_sha256 HAVING count(*) > 1)""", (), same("members", "surplus"))))
def _(spark, sf):
    m = f1(spark, sf)
    done = [c for c in m.columns if c.startswith("processed_")]
    return jobs.audit_canonical(m.drop(*done), m.where("order_key % 10 <> 3").select("sample_id", *done))


@query("i5_plan_train_view", with_(F1, LICENSED, AUGMENTED) + "SELECT * FROM aug")
def _(spark, sf):
    return derive.plan_train(licensed(spark, sf))


@query("i6_plan_robustness", with_(F1, LICENSED, ROBUSTNESS) + "SELECT * FROM rob")
def _(spark, sf):
    return derive.plan_robustness(licensed(spark, sf), strict=False)


_STATS = {"n": "z.n", "distinct_values": "z.distinct_values", "majority_accuracy": "z.majority_accuracy", "cramers_v": "z.cramers_v",
          "shared_values": "z.shared_values", "verdict": "z.verdict"}
_ALL_FEATURES = """(VALUES ('original source_dataset', source_dataset), ('original codec', codec), ('original original_sample_rate', CAST(original_sample_rate AS VARCHAR)),
 ('original bit_depth', bit_depth), ('original duration_bin', duration_bin), ('original gender_normalized', gender_normalized), ('original generator', generator), ('original voice', voice),
 ('canonical processed_codec', processed_codec), ('canonical processed_sample_rate', CAST(processed_sample_rate AS VARCHAR)), ('canonical processed_bit_depth', '16-bit PCM'),
 ('canonical processed_channels', CAST(processed_channels AS VARCHAR))) u(feature, value)"""
_MASTER_ROWS = shortcut_sql(f"""SELECT s.scope, u.feature, u.value, label FROM (SELECT *, CASE WHEN lower(trim(gender)) = 'male' THEN 'male' WHEN lower(trim(gender)) LIKE 'female%' THEN 'female' ELSE 'unknown' END AS gender_normalized FROM fx) fx,
 LATERAL (VALUES (language_type), ('all')) s(scope), LATERAL {_ALL_FEATURES}""")
_AUG_ROWS = shortcut_sql("SELECT s.scope, 'augmentation_condition' AS feature, augmentation_condition AS value, label FROM aug, LATERAL (VALUES (language_type), ('all')) s(scope)")


@query("i7_audit_shortcuts", with_(F1, LICENSED, AUGMENTED, ROBUSTNESS) + report(
    lines("master", f"WITH {_FEATURED.lstrip(', ')} {_MASTER_ROWS}", ("scope", "feature"), _STATS),
    lines("augmented", "WITH " + _AUG_ROWS.lstrip(", "), ("scope", "feature"), _STATS),
    lines("balance", """SELECT d, v, augmentation_condition, count(*) AS n FROM aug, LATERAL (VALUES ('source_dataset', source_dataset), ('label', label), ('generator', generator), ('voice', voice), ('gender_normalized', gender_normalized)) u(d, v)
      WHERE trim(v) <> '' GROUP BY 1, 2, 3""", ("d", "v", "augmentation_condition"), same("n")),
    lines("robustness", "SELECT count(*) AS total, bool_and(parent_split = 'test') AS all_parents_in_split, count(DISTINCT parent_sample_id) AS unique_parents FROM rob", (),
          same("total", "all_parents_in_split", "unique_parents")),
    lines("robustness by class", "SELECT augmentation_condition, label, count(*) AS n FROM rob GROUP BY 1, 2", ("augmentation_condition", "label"), same("n"))))
def _(spark, sf):
    m = licensed(spark, sf).withColumn("gender_normalized", clean.normalize_category("gender"))
    return jobs.audit_shortcuts(m, derive.plan_train(m), derive.plan_robustness(m, strict=False))


def _rule(part: str, rule: str, observed: str, expected) -> str:
    return f"SELECT '{part}' AS part, '{rule}' AS rule, CAST(({observed}) AS VARCHAR) AS observed, CAST(({expected}) AS VARCHAR) AS expected"


def _facts(part: str, rule: str, observed: str, rows: str) -> str:
    return f"SELECT '{part}' AS part, {rule} AS rule, CAST({observed} AS VARCHAR) AS observed, NULL AS expected FROM {rows}"


def _print(rows: str, identifier: str, content: str) -> str:
    """The tree fingerprint of a table as a table of one column."""
    line = f"CAST(length({identifier}) AS VARCHAR) || ':' || {identifier} || ':' || {content}"
    return f"""(SELECT sha256(string_agg(b || ':' || d || chr(10), '' ORDER BY b)) AS f FROM (
      SELECT substr(l, 1, 2) AS b, sha256(string_agg(l || ':' || d || chr(10), '' ORDER BY l)) AS d FROM (
       SELECT substr(sha256(line), 1, 5) AS l, sha256(string_agg(line || ':' || CAST(n AS VARCHAR) || chr(10), '' ORDER BY line)) AS d
       FROM (SELECT {line} AS line, count(*) AS n FROM {rows} GROUP BY 1) GROUP BY 1) GROUP BY 1))"""


def _uniform(column: str, value: str) -> str:
    return f"SELECT bool_and(CAST({column} AS VARCHAR) = '{value}') FROM m"


# of the master's files some are absent, some empty, some changed
_STORED = """stored AS (SELECT processed_file_path AS path, CASE WHEN order_key % 50 = 2 THEN 0 ELSE 1000 + order_key % 7 END AS length,
   CASE WHEN order_key % 50 = 3 THEN 'changed' ELSE processed_sha256 END AS sha256 FROM m WHERE order_key % 50 <> 1
  UNION ALL SELECT augmented_file_path, 700, sha256(augmented_file_path) FROM aug UNION ALL SELECT augmented_file_path, 600, sha256(augmented_file_path) FROM rob)"""
_LOST = "SELECT count(*) FROM {t} LEFT JOIN stored ON path = {p} WHERE {w}"


_SURPLUS = "SELECT count(*) - count(DISTINCT {c}) FROM {t}"
_LEAK = ("SELECT 2 * count(*) FROM (SELECT group_id FROM m GROUP BY 1 HAVING bool_or(split = '{a}') AND bool_or(split = '{b}'))")


@query("i8_freeze", with_(F1, LICENSED, AUGMENTED, ROBUSTNESS, _STORED) + ", rules AS (SELECT *, observed IS NOT DISTINCT FROM expected AS ok FROM (" + report(
    _rule("master", "master rows", "SELECT count(*) FROM m", "SELECT count(*) FROM orders"), _rule("master", "uniform rate", _uniform("processed_sample_rate", "16000"), "true"),
    _rule("master", "uniform channels", _uniform("processed_channels", "1"), "true"), _rule("master", "uniform codec", _uniform("processed_codec", "WAV/PCM_16"), "true"),
    _rule("master", "repeated sample_id", _SURPLUS.format(c="sample_id", t="m"), 0), _rule("master", "repeated path", _SURPLUS.format(c="processed_file_path", t="m"), 0),
    _rule("augmented", "augmented rows", "SELECT count(*) FROM aug", "SELECT count(*) FROM m WHERE split = 'train'"), _rule("augmented", "repeated id", _SURPLUS.format(c="augmentation_id", t="aug"), 0),
    _rule("augmented", "repeated path", _SURPLUS.format(c="augmented_file_path", t="aug"), 0),
    _rule("robustness", "robustness rows", "SELECT count(*) FROM rob", "SELECT 5 * sum(least(n, 100)) FROM (SELECT count(*) AS n FROM m WHERE split = 'test' GROUP BY language_type, label)"), _rule("robustness", "repeated id", _SURPLUS.format(c="robustness_id", t="rob"), 0),
    _rule("robustness", "repeated path", _SURPLUS.format(c="augmented_file_path", t="rob"), 0),
    *[_rule("group leakage", f"{a}/{b}", _LEAK.format(a=a, b=b), 0) for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))],
    *[_rule(f"{p} inheritance", r, f"SELECT count(*) FROM {t} c LEFT JOIN m ON m.sample_id = c.parent_sample_id WHERE {w}", 0)
      for p, t, s in (("augmented", "aug", "train"), ("robustness", "rob", "test"))
      for r, w in (("orphans", "m.sample_id IS NULL"), ("split_differs", "m.split IS DISTINCT FROM c.split"),
                   ("wrong_parent_split", f"c.parent_split <> '{s}'"), ("parent_outside_split", f"m.split IS DISTINCT FROM '{s}'"))],
    _rule("augmented inheritance", "repeated_parents", _SURPLUS.format(c="parent_sample_id", t="aug"), 0),
    _rule("overlap", "parents in both sets", "SELECT count(DISTINCT parent_sample_id) FROM aug WHERE parent_sample_id IN (SELECT parent_sample_id FROM rob)", 0),
    *[_rule(f"{n} content", rule, _LOST.format(t=t, p=p, w=w), 0)
      for n, t, p, h in (("master", "m", "processed_file_path", "processed_sha256"), ("augmented", "aug", "augmented_file_path", "sha256(augmented_file_path)"),
                         ("robustness", "rob", "augmented_file_path", "sha256(augmented_file_path)"))
      for rule, w in (("missing", "path IS NULL"), ("zero_byte", "length = 0"), ("hash_mismatches", f"length > 0 AND stored.sha256 <> {h}"))]) + """))
 SELECT * FROM rules UNION ALL SELECT 'verdict', 'frozen', CAST(bool_and(ok) AS VARCHAR), 'true', bool_and(ok) FROM rules
 UNION ALL SELECT *, NULL FROM (""" + report(
    _facts("parameters", "augmentation_condition || ' | ' || augmentation_parameters", "count(*)", "aug GROUP BY 2"),
    _facts("terms", "source_dataset || ' | ' || license || ' | ' || license_status", "count(*)", "m GROUP BY 2"),
    _facts("storage", "CASE WHEN grouping(d) = 1 THEN '(total)' ELSE d END", "CAST(sum(length) AS BIGINT)",
           "(SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, length FROM stored) GROUP BY ROLLUP (d)"),
    _facts("master content", "'fingerprint'", "f", _print("m", "sample_id", "processed_sha256")),
    _facts("augmented content", "'fingerprint'", "f", _print("aug", "augmentation_id", "sha256(augmented_file_path)")),
    _facts("robustness content", "'fingerprint'", "f", _print("rob", "robustness_id", "sha256(augmented_file_path)"))) + ")")
def _(spark, sf):
    m = licensed(spark, sf)
    a, r = with_audio(derive.plan_train(m)), with_audio(derive.plan_robustness(m, strict=False))
    stored = m.where("order_key % 50 <> 1").selectExpr(
        "processed_file_path AS path", "CAST(CASE WHEN order_key % 50 = 2 THEN 0 ELSE 1000 + order_key % 7 END AS BIGINT) AS length",
        "CASE WHEN order_key % 50 = 3 THEN 'changed' ELSE processed_sha256 END AS sha256").unionByName(
        a.selectExpr("augmented_file_path AS path", "700L AS length", "sha256")).unionByName(
        r.selectExpr("augmented_file_path AS path", "600L AS length", "sha256"))
    tests = m.where("split = 'test'").groupBy("language_type", "label").count().agg(F.sum(F.least("count", F.lit(100)))).first()[0]
    sizes = {"master": table(spark, sf, "orders").count(), "augmented": m.where("split = 'train'").count(), "robustness": 5 * tests}
    return jobs.freeze(m, a, r, sizes, stored)


def _published(spark, sf):
    m, docs = licensed(spark, sf), f2(spark, sf)
    external = docs.select("sample_id", "label", "source_dataset", F.lower("language_type").alias("source_model"), F.lit(None).cast("string").alias("spoof_type"),
                           F.col("bytes").alias("duration"), F.lit("text").alias("codec"), F.concat(F.lit("./"), F.col("path")).alias("file_path"))
    return jobs.publish(m, with_audio(derive.plan_train(m)), with_audio(derive.plan_robustness(m, strict=False)), "pepper",
                        external, "Mixed", docs.where("doc_key % 3 <> 0").select("path", "sha256"))


_PUBLIC = "'{n}' AS manifest, {i} AS sample_id, label, split, coalesce(generator, '') AS generator, substr(sha256('pepper|' || group_id), 1, 16) AS group_id, {p} AS path"


@query("i9_publish", with_(F1, F2, LICENSED, AUGMENTED, ROBUSTNESS) + report(
    f"SELECT {_PUBLIC.format(n='development', i='sample_id', p='processed_file_path')} FROM m",
    f"SELECT {_PUBLIC.format(n='augmented', i='augmentation_id', p='augmented_file_path')} FROM aug",
    f"SELECT {_PUBLIC.format(n='robustness', i='robustness_id', p='augmented_file_path')} FROM rob",
    "SELECT 'external', sample_id, label, 'evaluation', coalesce(lower(language_type), ''), substr(sha256('pepper|' || sample_id), 1, 16), path FROM f2"))
def _(spark, sf):
    made = _published(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), [
        df.select(F.lit(n).alias("manifest"), "sample_id", "label", "split", "generator", "group_id", "path") for n, df in made.items()])


@query("i9_check_published", with_(F1, F2, LICENSED, AUGMENTED, ROBUSTNESS) + """
SELECT 'development' AS manifest, count(*) FILTER (WHERE split = 'test') AS missing, 0 AS out_of_date, count(*) FILTER (WHERE split = 'test') = 0 AS "current" FROM m
UNION ALL SELECT 'augmented', 0, 0, true UNION ALL SELECT 'robustness', n, n, n = 0 FROM (SELECT count(*) AS n FROM rob WHERE label = 'fake')
UNION ALL SELECT 'external', 0, count(*), count(*) = 0 FROM f2 WHERE doc_key % 4 = 0""")
def _(spark, sf):
    """Published without the test rows, with other codecs for fakes, and with documents that are no longer there."""
    made = _published(spark, sf)
    stale = f2(spark, sf).where("doc_key % 4 = 0").select("sample_id")
    gone = made["external"].join(stale, "sample_id", "left_semi").withColumn("sample_id", F.concat("sample_id", F.lit("-old")))
    return jobs.check_published(made, {
        "development": made["development"].where("split <> 'test'"), "augmented": made["augmented"],
        "robustness": made["robustness"].withColumn("codec", F.when(F.col("label") == "fake", "other").otherwise(F.col("codec"))),
        "external": made["external"].unionByName(gone.select(made["external"].columns))})


PICKED = "WITH RECURSIVE " + SEGMENTS + """,
 us AS (SELECT * FROM seg WHERE speaker_id IS NOT NULL AND transcript IS NOT NULL AND wav_name IS NOT NULL AND end_time - start_time BETWEEN 1 AND 30),
 rr AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY sha256('42|' || utt_id), utt_id) AS round FROM us),
 pk AS (SELECT * FROM rr ORDER BY round, sha256('42|' || speaker_id), speaker_id LIMIT 200)""" + greedy_sql("pk", "speaker_id", "''", _PERCENT) + """,
 chosen AS (SELECT pk.*, f.split FROM pk JOIN f ON f.k = pk.speaker_id)"""


@query("i10_select_speech", PICKED + " SELECT utt_id, speaker_id, round, split FROM chosen")
def _(spark, sf):
    return jobs.select_speech(*kaldi(spark, sf), 200, strict=False).select("utt_id", "speaker_id", "round", "split")


_LEAKS = ("SELECT key, count(*) FILTER (WHERE a AND b) AS train_validation, count(*) FILTER (WHERE a AND c) AS train_test, count(*) FILTER (WHERE b AND c) AS validation_test "
          "FROM (SELECT u.key, u.value, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c "
          "FROM chosen, LATERAL (VALUES ('speaker_id', speaker_id), ('recording_id', recording_id)) u(key, value) GROUP BY 1, 2) GROUP BY 1")


@query("i10_speech_report", PICKED + report(
    " " + lines("slices", "SELECT count(*) AS segments, CAST(coalesce(sum(round_even(end_time * 10, 0) - round_even(start_time * 10, 0)), 0) AS BIGINT) AS frames, 0 AS empty FROM chosen", (),
                same("segments", "frames", "empty")),
    lines("leakage", _LEAKS, ("key",), same("train_validation", "train_test", "validation_test"))))
def _(spark, sf):
    """Ten frames a second; every turn of a conversation is covered to its end."""
    frames = table(spark, sf, "conversations").select(
        F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("recording"),
        F.posexplode(F.sequence(F.lit(0), F.length("role") * 3)).alias("k", "value"), "turn").select(
        "recording", (F.col("turn") * 25 + F.col("k")).cast("bigint").alias("frame"), F.col("value").cast("double").alias("value"))
    frames = frames.dropDuplicates(["recording", "frame"])
    return jobs.speech_report(jobs.select_speech(*kaldi(spark, sf), 200, strict=False), frames, 10)


EXTERNAL = with_(F1) + """
, kept AS (SELECT sample_id, order_key, label, session_id, source_dataset, coalesce(generator, 'unknown') AS g, coalesce(nullif(trim(voice), ''), 'unknown') AS v FROM f1
   WHERE NOT (label = 'real' AND coalesce(upstream_dataset, '') = 'corpus_b')),
 k AS (SELECT *, CASE WHEN label = 'real' THEN source_dataset ELSE g END AS g1, CASE WHEN label = 'real' THEN '' ELSE v END AS g2 FROM kept),
 a AS (SELECT *, row_number() OVER (PARTITION BY label, g1, g2, session_id ORDER BY order_key) AS turn FROM k),
 b AS (SELECT *, row_number() OVER (PARTITION BY label, g1, g2 ORDER BY turn, session_id) AS round FROM a),
 c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round, g1, g2) AS pos FROM b),
 picked AS (SELECT sample_id, label AS project_label, round FROM c WHERE pos <= 600)"""


def _external(spark, sf):
    index = f1(spark, sf).select("sample_id", "order_key", F.expr("CASE label WHEN 'real' THEN 'bonafide' ELSE 'spoof' END").alias("label"),
                                 F.col("upstream_dataset").alias("source_dataset"), F.col("source_dataset").alias("corpus"),
                                 "generator", "voice", "session_id")
    return jobs.select_external_eval(index, 600, ["corpus_b"], {"real": ["corpus"], "fake": ["generator", "voice"]}, "session_id", ["order_key"], strict=False)


@query("i11_select_external_eval", EXTERNAL + "SELECT * FROM picked")
def _(spark, sf):
    return _external(spark, sf).select("sample_id", "project_label", "round")


@query("i11_external_report", EXTERNAL + ", rules AS (SELECT 'rows' AS rule, CAST(count(*) AS VARCHAR) AS observed, '1200' AS expected FROM picked "
       "UNION ALL SELECT 'repeated id', CAST(count(*) - count(DISTINCT sample_id) AS VARCHAR), '0' FROM picked "
       "UNION ALL SELECT 'labels', CAST(count(DISTINCT project_label) = 2 AS VARCHAR), 'true' FROM picked) " + report(
           lines("quota", "SELECT project_label, count(*) AS available, 600 AS quota, count(*) >= 600 AS enough FROM picked GROUP BY 1", ("project_label",),
                 same("available", "quota", "enough")),
           lines("rule", "SELECT *, observed = expected AS ok, (SELECT bool_and(observed = expected) FROM rules) AS frozen FROM rules", ("rule",),
                 same("observed", "expected", "ok", "frozen"))))
def _(spark, sf):
    return jobs.external_report(_external(spark, sf), 600)


_FEATURE_SQL = """sig AS (SELECT label, list_max(list_transform(w, lambda v: abs(v))) AS peak, 20 * log10(sqrt(list_sum(list_transform(w, lambda v: v * v)) / len(w))) AS rms_dbfs,
  coalesce(list_min(list_filter(range(len(w)), lambda i: abs(w[i + 1]) > 0.2)), len(w)) / 16.0 AS leading_s,
  (len(w) - 1 - coalesce(list_max(list_filter(range(len(w)), lambda i: abs(w[i + 1]) > 0.2)), -1)) / 16.0 AS trailing_s
 FROM (SELECT label, list_transform(wave, lambda v: v::DOUBLE) AS w FROM f5)),
 x AS (SELECT c, v, label FROM sig, LATERAL (VALUES ('peak', peak), ('rms_dbfs', rms_dbfs), ('leading_s', leading_s), ('trailing_s', trailing_s)) u(c, v)),
 w AS (SELECT c, v, count(*) FILTER (WHERE label = 'fake') AS p, count(*) FILTER (WHERE label = 'real') AS q FROM x GROUP BY 1, 2),
 t AS (SELECT c, sum(p) AS pa, sum(q) AS qa FROM w GROUP BY 1),
 s AS (SELECT *, sum(p) OVER o AS pu, sum(q) OVER o AS qu FROM w JOIN t USING (c) WINDOW o AS (PARTITION BY c ORDER BY v)),
 r AS (SELECT c, avg(rk) FILTER (WHERE label = 'fake') AS mr FROM (SELECT c, label, rank() OVER (PARTITION BY c ORDER BY v) + (count(*) OVER (PARTITION BY c, v) - 1) / 2 AS rk FROM x) GROUP BY 1)"""


def _labelled_docs(spark, sf):
    return f2(spark, sf).withColumn("label", F.expr("CASE WHEN doc_key % 2 = 0 THEN 'real' ELSE 'fake' END"))


def _inventory(docs):
    return docs.select("path", F.col("bytes").alias("length"), "sha256", F.col("source_dataset").alias("collection"))


def _labelled_sounds(spark, sf):
    frames = f5(spark, sf).select(F.concat_ws("|", "sample_id", "label").alias("recording"), F.posexplode("wave").alias("frame", "value")) \
        .withColumn("value", F.col("value").cast("double"))
    return signals.features(frames, 0.2, 0.4, 16).withColumn("label", F.split_part("recording", F.lit("|"), F.lit(2)))


# both names read whole tables; only the path lists of coverage have holes
INDEPENDENT = with_(F2, F5, _FEATURE_SQL, f"""lab AS (SELECT *, CASE WHEN doc_key % 2 = 0 THEN 'real' ELSE 'fake' END AS l, {norm('transcript')} AS k FROM f2)""") + report(
    lines("coverage", """SELECT count(*) FILTER (WHERE doc_key % 5 <> 0) AS a, count(*) FILTER (WHERE doc_key % 3 <> 0) AS b, count(*) FILTER (WHERE doc_key % 5 <> 0 AND doc_key % 3 <> 0) AS c,
      count(*) FILTER (WHERE doc_key % 5 <> 0 AND doc_key % 3 = 0) AS d, count(*) FILTER (WHERE doc_key % 5 = 0 AND doc_key % 3 <> 0) AS e FROM f2""", (),
          {"referenced": "z.a", "on_disk": "z.b", "matched": "z.c", "referenced_but_missing": "z.d", "on_disk_but_unlabelled": "z.e", "referenced_twice": "0"}),
    lines("duplicates", """SELECT count(*) AS "groups", CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS redundant FROM (SELECT sha256, count(*) AS n FROM f2 GROUP BY 1) WHERE n > 1""", (),
          same("groups", "redundant")),
    lines("text reuse", """SELECT source_dataset, CAST(sum(n) AS BIGINT) AS clips, count(*) AS unique_texts, max(n) AS max_reuse, sum(n) = count(*) AS vacuous
      FROM (SELECT source_dataset, k, count(*) AS n FROM lab GROUP BY 1, 2) GROUP BY 1""", ("source_dataset",), same("clips", "unique_texts", "max_reuse", "vacuous")),
    lines("cross-label texts", """SELECT count(*) AS texts, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs FROM (SELECT k, (SELECT count(*) FROM lab a JOIN lab b ON a.k = b.k AND a.l = 'real' AND b.l = 'fake' AND a.split <> b.split WHERE a.k = lab.k) AS pairs
      FROM lab GROUP BY k HAVING count(DISTINCT l) = 2)""", (), same("texts", "pairs")),
    lines("threshold", """SELECT s.c, CAST(any_value(pa + qa) AS BIGINT) AS n, round(max(greatest(qu + pa - pu, pu + qa - qu, pa, qa)) / any_value(pa + qa), 6) AS best_accuracy,
      round((any_value(mr) - (any_value(pa) + 1) / 2) / any_value(qa), 6) AS auc FROM s JOIN r ON r.c = s.c GROUP BY s.c""", ("c",), same("n", "best_accuracy", "auc")))


@query("i12_independent_audit", INDEPENDENT)
@query("i12_independent_audit_whole", INDEPENDENT)
def _(spark, sf):
    docs = _labelled_docs(spark, sf)
    return jobs.independent_audit(docs, _inventory(docs), _labelled_sounds(spark, sf), docs.where("doc_key % 5 <> 0").select("path"),
                                  docs.where("doc_key % 3 <> 0").select("path"))
