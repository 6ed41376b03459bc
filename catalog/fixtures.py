"""Manifests derived from the driver's tables, each with the same definition in SQL.

Column definitions are written once in the SQL that both engines share; the two
functions that differ in name are filled in per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievewright.operators.sampling import occurrence_index


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its footer is read once for the schema."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _fill(expr: str, spark: bool) -> str:
    return expr.replace("SHA(", "sha2(" if spark else "sha256(").replace("#)", ", 256)" if spark else ")")


_SPLIT20 = "CASE WHEN {k} % 20 < 14 THEN 'train' WHEN {k} % 20 < 17 THEN 'validation' ELSE 'test' END"

# ---- F1: order manifest ----

F1_COLUMNS = {
    "sample_id": "CAST(o_orderkey AS STRING)",
    "file_path": "'./data' || chr(92) || r_name || chr(92) || 'ord_' || CAST(o_orderkey AS STRING) || '.wav'",
    "source_dataset": "o_orderpriority",
    "language_type": "r_name",
    "label": "CASE WHEN o_orderstatus = 'F' THEN 'real' ELSE 'fake' END",
    "generator": "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE c_mktsegment END",
    "voice": "CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'v' || CAST(o_custkey % 7 AS STRING) END",
    "speaker_id": "CAST(o_custkey AS STRING)",
    "group_id": "o_orderpriority || '::' || CAST(o_custkey AS STRING)",
    "session_id": "'s' || CAST(o_custkey % 50 AS STRING)",
    "source_file_id": "CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 9 AS STRING)",
    "gender": "CASE o_custkey % 6 WHEN 0 THEN 'Male' WHEN 1 THEN 'female_feminine' WHEN 2 THEN 'nan' "
              "WHEN 3 THEN '' WHEN 4 THEN ' FEMALE ' ELSE 'other' END",
    "split": _SPLIT20.format(k="o_orderkey"),
    "duration": "o_totalprice / 10000",
    "original_sample_rate": "CASE o_custkey % 3 WHEN 0 THEN 16000 WHEN 1 THEN 24000 ELSE 48000 END",
    "codec": "CASE o_orderkey % 4 WHEN 0 THEN 'WAV/PCM_16' WHEN 1 THEN 'FLAC/PCM_24' "
             "WHEN 2 THEN 'MP3/MPEG_LAYER_III' ELSE 'OGG/VORBIS' END",
    "channels": "1",
    "file_bytes": "CASE WHEN o_orderkey % 89 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END",
    "sha256": "SHA(CAST(o_orderkey AS STRING)#)",
    "transcript": "c_name",
    "declared_duration": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 "
                         "THEN o_totalprice / 10000 + 0.06 ELSE o_totalprice / 10000 END",
    "declared_sample_rate": "CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' WHEN o_orderkey % 17 = 0 THEN NULL "
                            "WHEN o_orderkey % 5 = 0 THEN '16000' ELSE CAST(CASE o_custkey % 3 WHEN 0 THEN 16000 "
                            "WHEN 1 THEN 24000 ELSE 48000 END AS STRING) END",
    "exists": "o_orderkey % 97 <> 0",
    "probe_error": "CASE WHEN o_orderkey % 101 = 0 THEN 'bad header' END",
    "upstream_dataset": "CASE o_custkey % 4 WHEN 0 THEN 'corpus_a' WHEN 1 THEN 'corpus_ab' WHEN 2 THEN 'corpus_b' END",
    "processed_file_path": "'data/processed/ord_' || CAST(o_orderkey AS STRING) || '.wav'",
    "processed_sample_rate": "16000",
    "processed_channels": "1",
    "processed_codec": "'WAV/PCM_16'",
    "processed_duration": "o_totalprice / 10000 + (o_orderkey % 10) * 0.01",
    "processed_sha256": "SHA('p' || CAST(o_orderkey AS STRING)#)",
    "order_key": "o_orderkey",
}
_F1_FROM = ("FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
            "JOIN region ON n_regionkey = r_regionkey")


def _definition(columns: dict, source: str, name: str) -> str:
    body = ", ".join(f'{_fill(e, False)} AS "{c}"' for c, e in columns.items())
    return f"{name} AS (SELECT {body} {source})"


F1 = _definition(F1_COLUMNS, _F1_FROM, "f1")


def f1(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: table(spark, sf, n) for n in ("orders", "customer", "nation", "region")}
    joined = (t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
              .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
              .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")))
    return joined.selectExpr(*[f"{_fill(e, True)} AS `{c}`" for c, e in F1_COLUMNS.items()])


# ---- F2: document manifest ----

F2_COLUMNS = {
    "sample_id": "CAST(documents.doc_id AS STRING)",
    "doc_key": "documents.doc_id",
    "source_dataset": "source",
    "language_type": "lang",
    "transcript": "text",
    "sha256": "SHA(text#)",
    "label": "CASE quality WHEN 1 THEN 'real' WHEN 0 THEN 'fake' END",
    "bytes": "n_chars",
    "path": "'data/' || source || '/' || lang || '/' || CAST(documents.doc_id AS STRING) || '.txt'",
    "split": _SPLIT20.format(k="documents.doc_id"),
}
F2 = _definition(F2_COLUMNS, "FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id", "f2")


def f2(spark: SparkSession, sf: str) -> DataFrame:
    d, q = table(spark, sf, "documents").alias("documents"), table(spark, sf, "labels").alias("labels")
    return d.join(q, F.col("documents.doc_id") == F.col("labels.doc_id"), "left").selectExpr(
        *[f"{_fill(e, True)} AS `{c}`" for c, e in F2_COLUMNS.items()])


# ---- F3: line table ----

F3_COLUMNS = {
    "row_key": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) "
               "|| '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING)",
    "order_key": "l_orderkey",
    "line": "l_linenumber",
    "part": "l_partkey",
    "entity": "CAST(l_suppkey AS STRING)",
    "generator": "l_returnflag",
    "domain": "l_linestatus",
    "duration": "l_quantity",
    "price": "l_extendedprice",
}
F3 = _definition(F3_COLUMNS, "FROM lineitem", "f3")
F3_ORDER = ["order_key", "line", "part", "entity", "duration", "price"]
F3_ORDER_SQL = ", ".join(F3_ORDER)


def f3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*[f"{_fill(e, True)} AS `{c}`" for c, e in F3_COLUMNS.items()])


# ---- F4: event signal ----

F4 = ("f4 AS (SELECT CAST(user_id AS STRING) AS recording, "
      "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value / 500 AS value FROM events)")


def f4_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("CAST(user_id AS STRING) AS recording", "value / 500 AS value")


def f4(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "events").selectExpr(
        "CAST(user_id AS STRING) AS recording", "ts", "event_id", "value / 500 AS value")
    return occurrence_index(named, "recording", ["ts", "event_id"], "frame").select("recording", "frame", "value")


# ---- F5: vectors ----

F5 = ("f5 AS (SELECT CAST(vec_id AS STRING) AS sample_id, embedding AS wave, "
      "CASE WHEN label % 2 = 0 THEN 'real' ELSE 'fake' END AS label, "
      "'src' || CAST(label AS STRING) AS source_dataset FROM embeddings)")


def f5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "CAST(vec_id AS STRING) AS sample_id", "embedding AS wave",
        "CASE WHEN label % 2 = 0 THEN 'real' ELSE 'fake' END AS label", "'src' || CAST(label AS STRING) AS source_dataset")


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


# ---- derived manifests of F1 ----

LICENSES = [("1-URGENT", "CC0-1.0", "VERIFIED"), ("2-HIGH", "CC BY 4.0", "VERIFIED"),
            ("3-MEDIUM", "CC BY-NC 4.0", "VERIFIED"), ("5-LOW", "none stated upstream", "UNVERIFIED")]
LICENSES_SQL = ("lic(source_dataset, license, license_status) AS (VALUES "
                + ", ".join(str(r) for r in LICENSES) + ")")


def licenses(spark: SparkSession) -> DataFrame:
    """As values in the plan: Spark knows the size of these and need not shuffle a manifest by its few sources to join them."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in LICENSES) + " AS lic(source_dataset, license, license_status)")


def licensed(spark: SparkSession, sf: str) -> DataFrame:
    from sievewright.operators.conform import attach_lookup
    return attach_lookup(f1(spark, sf), "source_dataset", licenses(spark),
                         {"license": "unknown", "license_status": "UNVERIFIED"})


LICENSED = (LICENSES_SQL + ", m AS (SELECT f1.*, coalesce(lic.license, 'unknown') AS license, "
            "coalesce(lic.license_status, 'UNVERIFIED') AS license_status FROM f1 LEFT JOIN lic USING (source_dataset))")

_CONDITIONS = ("['mp3_32','mp3_64','mp3_128','opus_12','opus_24','opus_48','telephone','lowpass','gain',"
               "'mild_clipping','multi_codec']")

_PARAMS = """CASE
 WHEN c LIKE 'mp3%' THEN '{"bitrate_kbps":' || split_part(c, '_', 2) || ',"codec":"mp3"}'
 WHEN c LIKE 'opus%' THEN '{"bitrate_kbps":' || split_part(c, '_', 2) || ',"codec":"opus"}'
 WHEN c = 'telephone' THEN '{"band_hz":"300-3400","intermediate_rate":8000}'
 WHEN c = 'lowpass' THEN '{"cutoff_hz":' || CAST([4000,5000,6000,7000][pos % 4 + 1] AS VARCHAR) || '}'
 WHEN c = 'gain' THEN '{"gain_db":' || CAST([-9,-6,-3,3][pos % 4 + 1] AS VARCHAR) || '}'
 WHEN c = 'mild_clipping' THEN '{"boost_db":6}'
 ELSE '{"chain":"' || ['mp3_64__opus_24','opus_24__mp3_64'][pos % 2 + 1] || '"}' END"""

# position of every training row in its stratum, then condition and parameters
DEALT = f"""dealt AS (
 SELECT *, {_PARAMS} AS params FROM (
  SELECT *, {_CONDITIONS}[pos % 11 + 1] AS c FROM (
   SELECT *, row_number() OVER (PARTITION BY source_dataset, label, language_type
                                ORDER BY sha256('42|' || sample_id), sample_id) - 1 AS pos
   FROM m WHERE split = 'train')))"""

_DERIVED_COLUMNS = """language_type, label, source_dataset, split, group_id, generator, voice,
 CASE WHEN lower(trim(gender)) = 'male' THEN 'male' WHEN lower(trim(gender)) LIKE 'female%' THEN 'female' ELSE 'unknown' END AS gender_normalized,
 split AS parent_split, processed_file_path AS parent_processed_path, processed_duration AS parent_duration,
 c AS augmentation_condition, params AS augmentation_parameters, license, license_status,
 CASE WHEN license_status = 'UNVERIFIED' THEN 'false' ELSE 'true' END AS redistribution_allowed"""

AUGMENTED = DEALT + f""", aug AS (
 SELECT 'aug_' || sample_id || '__' || c AS augmentation_id, sample_id AS parent_sample_id,
  'data/augmented/aug_' || sample_id || '__' || c || '.wav' AS augmented_file_path, {_DERIVED_COLUMNS} FROM dealt)"""

ROBUSTNESS = f"""cond(c, params) AS (VALUES ('mp3', '{{"bitrate_kbps":64,"codec":"mp3"}}'),
  ('opus', '{{"bitrate_kbps":24,"codec":"opus"}}'),
  ('telephone', '{{"band_hz":"300-3400","intermediate_rate":8000}}'), ('lowpass', '{{"cutoff_hz":4000}}'),
  ('multi_codec', '{{"chain":"mp3_64__opus_24"}}')),
 rob AS (SELECT 'rob_' || sample_id || '__' || c AS robustness_id, sample_id AS parent_sample_id,
  'data/robustness/rob_' || sample_id || '__' || c || '.wav' AS augmented_file_path, {_DERIVED_COLUMNS}
  FROM (SELECT *, row_number() OVER (PARTITION BY language_type, label
          ORDER BY sha256('43|' || sample_id), sample_id) AS rn FROM m WHERE split = 'test') CROSS JOIN cond
  WHERE rn <= 100)"""

AUDIO_SQL = "'WAV/PCM_16' AS codec, CAST(1.5 AS DOUBLE) AS duration"


def with_audio(df: DataFrame) -> DataFrame:
    """Audio facts of rendered files, for manifests that only plan them."""
    return df.withColumns({"codec": F.lit("WAV/PCM_16"), "duration": F.lit(1.5),
                           "sha256": F.sha2(F.col("augmented_file_path"), 256)})

# blocks of 50 events: rows of each user per block
PROFILE_SQL = ("p AS (SELECT user_id, 'events.parquet' AS file, event_id // 50 AS block, count(*) AS num_rows "
               "FROM events GROUP BY 1, 2, 3)")
