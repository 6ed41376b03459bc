"""Projections, scalar cleaning, redaction."""

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import (AUDIO_SQL, AUGMENTED, F1, F2, LICENSED, LICENSES_SQL, f1, f2, licensed, licenses, table,
                              with_, with_audio)
from sievewright.functions import clean
from sievewright.operators import conform, counts, derive, sampling

WS = r"[\s\x{0b}\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def norm(column: str) -> str:
    """SQL form of the loose text normalisation."""
    return f"trim(regexp_replace(lower({column}), '{WS}', ' ', 'g'))"


@query("b1_align_source", with_(F1) + """
SELECT sample_id, language_type AS language, duration AS declared_duration, CAST(NULL AS VARCHAR) AS declared_license,
 'metadata/orders.csv' AS origin_metadata_file FROM f1""")
def _(spark, sf):
    return conform.align_source(f1(spark, sf), {
        "sample_id": "sample_id", "language": "language_type", "declared_duration": "duration",
        "declared_license": "license"}, "metadata/orders.csv")


@query("b2_unify_entity_id", with_(F1) + """
SELECT 'a' AS part, sample_id, speaker_id, speaker_id AS target_speaker_id, session_id AS source_speaker_id FROM f1
UNION ALL SELECT 'b', sample_id, speaker_id, NULL, NULL FROM f1
UNION ALL SELECT 'c', sample_id, NULL, NULL, NULL FROM f1""")
def _(spark, sf):
    base = f1(spark, sf).select("sample_id", "speaker_id", "session_id")
    parts = {"a": base.select("sample_id", F.lit("unused").alias("speaker_id"), F.col("speaker_id").alias("target_speaker_id"),
                              F.col("session_id").alias("source_speaker_id")),
             "b": base.select("sample_id", "speaker_id"), "c": base.select("sample_id")}
    a, b, c = [conform.unify_entity_id(df).withColumn("part", F.lit(p)) for p, df in parts.items()]
    return a.unionByName(b).unionByName(c)


@query("b3_select_existing", with_(F1) + "SELECT label, sample_id FROM f1")
def _(spark, sf):
    return conform.select_existing(f1(spark, sf), ["label", "nothing", "sample_id"])


@query("b4_attach_lookup", with_(F1, LICENSES_SQL) + """
SELECT sample_id, source_dataset, coalesce(license, 'unknown') AS license,
 coalesce(license_status, 'UNVERIFIED') AS license_status FROM f1 LEFT JOIN lic USING (source_dataset)""")
def _(spark, sf):
    return conform.attach_lookup(f1(spark, sf).select("sample_id", "source_dataset"), "source_dataset", licenses(spark),
                                 {"license": "unknown", "license_status": "UNVERIFIED"})


@query("b5_blank_to_null", """
SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN NULL ELSE role END AS role FROM conversations""")
def _(spark, sf):
    padded = F.expr("CASE turn % 3 WHEN 0 THEN chr(9) || ' ' || role || chr(160) || chr(10) "
                    "WHEN 1 THEN ' ' || chr(160) || chr(9) ELSE role END")
    return table(spark, sf, "conversations").select("conv_id", "turn", clean.blank_to_null(padded).alias("role"))


@query("b6_normalize_numeric_id", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS from_text, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS from_double
FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    written = F.expr("CASE o_orderkey % 3 WHEN 0 THEN o_custkey || '.0' WHEN 1 THEN ' ' || o_custkey || '.000 ' ELSE o_custkey || '' END")
    number = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN double('NaN') ELSE CAST(o_custkey AS DOUBLE) END")
    mixed = o.select("o_orderkey", written.alias("t"), number.alias("d"))
    return mixed.select("o_orderkey", clean.normalize_numeric_id("t").alias("from_text"),
                        clean.normalize_numeric_id("d", mixed.schema["d"].dataType).alias("from_double"))


ALIASED = """CASE o_orderkey % 6 WHEN 0 THEN 'XTTS-V2' WHEN 1 THEN 'xttsv2' WHEN 2 THEN ' FreeVC' WHEN 3 THEN 'freevc 24'
 WHEN 4 THEN 'VITS' ELSE o_orderpriority END"""


@query("b7_normalize_alias", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'xtts_v2' WHEN 1 THEN 'xtts_v2' WHEN 2 THEN 'freevc24' WHEN 3 THEN 'freevc24'
 WHEN 4 THEN 'vits' ELSE replace(replace(lower(o_orderpriority), '-', '_'), ' ', '_') END AS generator FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", clean.normalize_alias(F.expr(ALIASED)).alias("generator"))


@query("b8_normalize_category", with_(F1) + """
SELECT sample_id, CASE WHEN lower(trim(gender)) IN ('male', 'male_masculine') THEN 'male'
 WHEN lower(trim(gender)) IN ('female', 'female_feminine') THEN 'female' ELSE 'unknown' END AS gender_normalized FROM f1""")
def _(spark, sf):
    return f1(spark, sf).select("sample_id", clean.normalize_category("gender").alias("gender_normalized"))


@query("b9_normalize_text", f"SELECT doc_id, {norm('text')} AS text_key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean.normalize_text("text").alias("text_key"))


# the tables hold no compatibility characters, so NFC, which SQL has, equals NFKC here
NO_PUNCTUATION = r"regexp_replace(nfc_normalize(text), '\pP', '', 'g')"


@query("b10_normalize_text_strict", f"SELECT doc_id, {norm(NO_PUNCTUATION)} AS text_key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean.normalize_text_strict("text").alias("text_key"))


ACCENTED = "[À-ɏ]"


@query("b11_is_code_switched", """
SELECT doc_id, regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[À-ɏ]') AS code_switched FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean.is_code_switched("text", ACCENTED, clean.LATIN).alias("code_switched"))


@query("b12_script_profile", """
SELECT CASE WHEN regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[À-ɏ]') THEN 'code_switched'
 WHEN regexp_matches(text, '[À-ɏ]') THEN 'accented' ELSE 'latin' END AS script, count(*) AS n,
 count(*) FILTER (WHERE lang = 'fr') AS declared_mixed, count(*) FILTER (WHERE lang IS DISTINCT FROM 'fr') AS not_declared_mixed
FROM documents GROUP BY 1""")
def _(spark, sf):
    return counts.script_profile(table(spark, sf, "documents"), "text", "lang", "fr", ACCENTED, clean.LATIN, "accented", "latin")


@query("b13_composite_group_id", with_(F1) + f"""
SELECT sample_id, source_dataset || '::' || CASE WHEN source_dataset = '5-LOW' THEN {norm('transcript')}
 WHEN source_dataset = '1-URGENT' THEN session_id ELSE speaker_id END AS group_id FROM f1""")
def _(spark, sf):
    return f1(spark, sf).select("sample_id", clean.composite_group_id(
        "source_dataset", {"5-LOW": "transcript", "1-URGENT": "session_id"}, "speaker_id").alias("group_id"))


@query("b14_relativize_path", with_(F1) + """
SELECT sample_id, ltrim(replace(file_path, chr(92), '/'), './') AS path FROM f1""")
def _(spark, sf):
    return f1(spark, sf).select("sample_id", clean.relativize_path("file_path").alias("path"))


@query("b15_path_tail", """
SELECT page_id, regexp_extract(url, '(/en/.*)$', 1) AS tail FROM pages WHERE contains(url, '/en/')""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", clean.path_tail("url", "/en/").alias("tail")).where("tail IS NOT NULL")


@query("b16_path_part", """
WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'x' || CAST(page_id AS VARCHAR) || '.wav' ELSE regexp_replace(url, '^https?://', '') END AS rel FROM pages)
SELECT page_id, split_part(rel, '/', 1) AS first_part, CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 2) ELSE 'root' END AS bucket FROM p""")
def _(spark, sf):
    rel = F.expr("CASE WHEN page_id % 4 = 0 THEN 'x' || page_id || '.wav' ELSE regexp_replace(url, '^https?://', '') END")
    return table(spark, sf, "pages").select("page_id", rel.alias("rel")).select(
        "page_id", clean.path_part("rel", 1).alias("first_part"), clean.path_bucket("rel").alias("bucket"))


@query("b17_map_label", """
SELECT doc_id, CASE quality WHEN 1 THEN 'real' WHEN 0 THEN 'fake' END AS label FROM labels""")
def _(spark, sf):
    raw = F.expr("CASE quality WHEN 1 THEN 'bonafide' ELSE 'spoof' END")
    return table(spark, sf, "labels").select("doc_id", clean.map_label(raw).alias("label"))


@query("b18_derive_family", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (2, 3) THEN 'voice_conversion' ELSE 'text_to_speech' END AS family FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", clean.derive_family(clean.normalize_alias(F.expr(ALIASED))).alias("family"))


@query("b19_bit_depth", with_(F1) + """
SELECT sample_id, CASE WHEN contains(codec, 'PCM_16') THEN '16-bit PCM' WHEN contains(codec, 'PCM_24') THEN '24-bit PCM'
 WHEN contains(codec, 'MPEG_LAYER_III') THEN 'lossy (MP3)' WHEN contains(codec, 'VORBIS') THEN 'lossy (Opus/Vorbis)' ELSE 'other' END AS bit_depth FROM f1""")
def _(spark, sf):
    return f1(spark, sf).select("sample_id", clean.bit_depth("codec").alias("bit_depth"))


BIN = """CASE WHEN d >= 0 AND d < 1 THEN '<1s' WHEN d >= 1 AND d < 2 THEN '1-2s' WHEN d >= 2 AND d < 3 THEN '2-3s'
 WHEN d >= 3 AND d < 5 THEN '3-5s' WHEN d >= 5 AND d < 8 THEN '5-8s' WHEN d >= 8 AND d < 12 THEN '8-12s'
 WHEN d >= 12 AND d < 20 THEN '12-20s' WHEN d >= 20 AND d < 1e9 THEN '>20s' ELSE 'nan' END"""


@query("b20_bin_numeric", with_(F1) + f"""
SELECT sample_id, {BIN} AS duration_bin FROM (SELECT sample_id, CASE WHEN order_key % 19 = 0 THEN NULL ELSE round(duration) END AS d FROM f1)""")
def _(spark, sf):
    written = F.expr("CASE WHEN order_key % 19 = 0 THEN 'n/a' ELSE CAST(CAST(round(duration) AS INT) AS STRING) END")
    return f1(spark, sf).select("sample_id", clean.bin_numeric(written).alias("duration_bin"))


@query("b21_usable_filter", with_(F1) + """
SELECT sample_id, duration FROM f1 WHERE generator IS NOT NULL AND declared_duration IS NOT NULL AND duration BETWEEN 1 AND 30""")
def _(spark, sf):
    return conform.usable_filter(f1(spark, sf), ["generator", "declared_duration"], "duration", 1, 30).select("sample_id", "duration")


@query("b21_usable_counts", with_(F1) + """
SELECT source_dataset, count(*) FILTER (WHERE ok) AS usable, count(*) FILTER (WHERE NOT ok) AS dropped
FROM (SELECT *, generator IS NOT NULL AND duration BETWEEN 1 AND 30 AS ok FROM f1) GROUP BY 1""")
def _(spark, sf):
    return conform.usable_counts(f1(spark, sf), ["generator"], "duration", 1, 30, ["source_dataset"])


@query("b22_exclude_upstream", with_(F1) + """
SELECT sample_id, label, upstream_dataset FROM f1 WHERE NOT (label = 'real' AND coalesce(upstream_dataset, '') IN ('corpus_a', 'corpus_z'))""")
def _(spark, sf):
    return conform.exclude_upstream(f1(spark, sf), "real", ["corpus_a", "corpus_z"]).select("sample_id", "label", "upstream_dataset")


@query("b23_min_available", with_(F1) + """
SELECT label, count(*) AS available, CAST(1000 AS BIGINT) AS quota, count(*) >= 1000 AS enough FROM f1 GROUP BY label""")
def _(spark, sf):
    return conform.availability(f1(spark, sf), 1000, ["label"])


@query("b24_format_ids", with_(F1) + """
SELECT sample_id, label, 'ord_' || lpad(CAST(row_number() OVER (PARTITION BY label ORDER BY file_path, sample_id) - 1 AS VARCHAR), 7, '0') AS new_id FROM f1""")
def _(spark, sf):
    named = f1(spark, sf).select("sample_id", "label", "file_path")
    return conform.format_ids(named, "ord_", ["file_path", "sample_id"], ["label"], 7, "new_id").drop("file_path")


@query("b25_redistribution_flag", with_(F1, LICENSED) + """
SELECT sample_id, CASE WHEN upper(license_status) = 'UNVERIFIED' THEN 'false' ELSE 'true' END AS redistribution_allowed FROM m""")
def _(spark, sf):
    return licensed(spark, sf).select("sample_id", clean.redistribution_flag(F.lower("license_status")).alias("redistribution_allowed"))


@query("b26_params_json", """
SELECT o_orderkey, '{"bitrate_kbps":' || CAST(32 * (1 + o_orderkey % 4) AS VARCHAR) || ',"codec":"' || o_orderpriority || '"}' AS params FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", clean.params_json(
        codec=F.col("o_orderpriority"), bitrate_kbps=32 * (1 + F.col("o_orderkey") % 4)).alias("params"))


@query("b27_salted_hash", with_(F1) + """
SELECT sample_id, substr(sha256('pepper|' || coalesce(generator, '')), 1, 16) AS hashed FROM f1""")
def _(spark, sf):
    return f1(spark, sf).select("sample_id", clean.salted_hash("generator", "pepper").alias("hashed"))


ID = """CASE WHEN o_orderkey % 8 = 0 THEN 'x' || CAST(o_orderkey AS STRING) ELSE lpad(CAST(o_orderkey AS STRING), 15, '8') || '-'
 || CAST(o_custkey AS STRING) || '-' || CASE WHEN o_custkey % 2 = 0 THEN 'f' ELSE 'm' END || '.wav' END"""


@query("b28_decompose_id", f"""
SELECT o_orderkey, CASE WHEN matched THEN substr(id, 1, 15) END AS prefix, CASE WHEN matched THEN CAST(o_custkey AS VARCHAR) END AS speaker,
 CASE WHEN matched THEN CASE WHEN o_custkey % 2 = 0 THEN 'f' ELSE 'm' END END AS gender, matched
FROM (SELECT *, {ID} AS id, o_orderkey % 8 <> 0 AS matched FROM orders)""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(ID).alias("id")).select("o_orderkey", *clean.decompose_id("id"))


@query("b29_name_template", """
SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[0-9]+', '#', 'g') AS template, count(*) AS n
FROM pages GROUP BY 1, 2""")
def _(spark, sf):
    return counts.name_templates(table(spark, sf, "pages"), "url")


@query("b30_redact_master", with_(F1) + """
SELECT sample_id, label, language_type, source_dataset, coalesce(generator, '') AS generator, split, processed_duration AS duration,
 processed_codec AS codec, processed_sha256 AS sha256, substr(sha256('pepper|' || group_id), 1, 16) AS group_id,
 processed_file_path AS path FROM f1""")
def _(spark, sf):
    return conform.assert_publishable(conform.redact_master(f1(spark, sf), "pepper"))


@query("b30_redact_derived", with_(F1, LICENSED, AUGMENTED) + f"""
SELECT augmentation_id AS sample_id, parent_sample_id, label, language_type, source_dataset, coalesce(generator, '') AS generator, split,
 augmentation_condition, {AUDIO_SQL}, sha256(augmented_file_path) AS sha256,
 substr(sha256('pepper|' || group_id), 1, 16) AS group_id, augmented_file_path AS path FROM aug""")
def _(spark, sf):
    return conform.redact_derived(with_audio(derive.plan_train(licensed(spark, sf))), "augmentation_id", "pepper")


@query("b30_redact_external", with_(F2) + """
SELECT sample_id, label, 'Mixed' AS language_type, source_dataset, coalesce(lower(language_type), '') AS generator, 'evaluation' AS split,
 '' AS spoof_type, bytes AS duration, 'text' AS codec, CASE WHEN doc_key % 3 = 0 THEN '' ELSE sha256 END AS sha256,
 substr(sha256('pepper|' || sample_id), 1, 16) AS group_id, path FROM f2""")
def _(spark, sf):
    docs = f2(spark, sf)
    external = docs.select("sample_id", "label", "source_dataset", F.lower("language_type").alias("source_model"),
                           F.lit(None).cast("string").alias("spoof_type"), F.col("bytes").alias("duration"),
                           F.lit("text").alias("codec"), F.concat(F.lit("./"), F.col("path")).alias("file_path"))
    inventory = docs.where("doc_key % 3 <> 0").select("path", "sha256")
    return conform.redact_external(external, "pepper", "Mixed", inventory)


@query("b31_forbid", with_(F1) + """
SELECT 'transcript' AS column_name, 'forbidden column' AS "check", (SELECT count(*) FROM f1) AS violations
UNION ALL SELECT 'transcript', 'absolute user path', (SELECT count(*) FROM f1 WHERE order_key % 10 = 0)
UNION ALL SELECT 'group_id', 'unhashed group', (SELECT count(*) FROM f1)
UNION ALL SELECT 'group_id', 'absolute user path', 0 UNION ALL SELECT 'sample_id', 'absolute user path', 0""")
def _(spark, sf):
    planted = F.expr(r"CASE WHEN order_key % 10 = 0 THEN 'see C:\\Users\\someone' ELSE transcript END")
    return conform.forbid(f1(spark, sf).select("sample_id", "group_id", planted.alias("transcript")))


@query("b32_sample_rows", with_(F1) + "SELECT sample_id, label FROM f1 WHERE file_bytes = 0 ORDER BY sample_id LIMIT 10")
def _(spark, sf):
    return conform.sample_rows(f1(spark, sf).where("file_bytes = 0").select("sample_id", "label"), 10)


@query("e23_id_sorted", with_(F1) + "SELECT sample_id, label FROM f1")
def _(spark, sf):
    return conform.id_sorted(f1(spark, sf).select("sample_id", "label"), "sample_id")


@query("e22_occurrence_index", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS occurrence FROM events""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return sampling.occurrence_index(rows, "user_id", ["ts", "event_id"]).select("event_id", "occurrence")
