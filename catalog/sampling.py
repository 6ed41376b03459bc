"""Seeded orders, round robins, quotas, caps, dealing."""

from pyspark.sql import functions as F

from catalog import query
from catalog.cleaning import norm
from catalog.fixtures import (AUGMENTED, DEALT, F1, F2, F3, F3_ORDER, F3_ORDER_SQL, LICENSED, PROFILE_SQL, ROBUSTNESS, f1, f2, f3,
                              licensed, table, with_)
from sievewright.functions import clean
from sievewright.operators import derive, sampling
from sievewright.sources import blocks


@query("e1_seeded_order", with_(F1) + "SELECT sample_id, label FROM f1 ORDER BY sha256('7|' || sample_id), sample_id LIMIT 500")
def _(spark, sf):
    return sampling.seeded_order(f1(spark, sf).select("sample_id", "label"), "sample_id", 7, 500)


@query("e2_round_robin_sample", with_(F1) + """
, r AS (SELECT sample_id, speaker_id, row_number() OVER (PARTITION BY speaker_id ORDER BY sha256('42|' || sample_id), sample_id) AS round FROM f1)
SELECT * FROM r ORDER BY round, sha256('42|' || speaker_id), speaker_id LIMIT 5000""")
def _(spark, sf):
    return sampling.round_robin_sample(f1(spark, sf).select("sample_id", "speaker_id"), "speaker_id", 5000, strict=False)


@query("e2_round_robin_few_groups", with_(F1) + """
, r AS (SELECT sample_id, generator, row_number() OVER (PARTITION BY generator ORDER BY sha256('42|' || sample_id), sample_id) AS round FROM f1)
SELECT * FROM r ORDER BY round, sha256('42|' || coalesce(generator, '')), coalesce(generator, '') LIMIT 7003""")
def _(spark, sf):
    return sampling.round_robin_sample(f1(spark, sf).select("sample_id", "generator"), "generator", 7003, strict=False)


@query("e3_nested_round_robin", with_(F1) + """
, k AS (SELECT sample_id, order_key, source_dataset, coalesce(nullif(trim(voice), ''), 'unknown') AS v, coalesce(generator, 'unknown') AS g FROM f1),
 a AS (SELECT *, row_number() OVER (PARTITION BY source_dataset, v, g ORDER BY order_key) AS turn FROM k),
 b AS (SELECT *, row_number() OVER (PARTITION BY source_dataset, v ORDER BY turn, g) AS round FROM a)
SELECT sample_id, round FROM b ORDER BY round, source_dataset, v LIMIT 2000""")
def _(spark, sf):
    rows = f1(spark, sf).select("sample_id", "order_key", "source_dataset", "voice", "generator")
    return sampling.nested_round_robin(rows, ["source_dataset", "voice"], "generator", 2000, ["order_key"], strict=False).select("sample_id", "round")


@query("e2_round_robin_shortfall", with_(F1) + "SELECT count(*) + 17 AS wanted, count(*) AS got FROM f1")
def _(spark, sf):
    """Seventeen rows more are asked for than there are."""
    rows = f1(spark, sf)
    return sampling.shortfall(rows, [], rows.agg((F.count("*") + 17).alias("quota")))


@query("e3_nested_shortfall", with_(F1) + """
SELECT label, 2 * count(*) - 1 AS wanted, count(*) AS got FROM f1 WHERE label = 'real' GROUP BY 1""")
def _(spark, sf):
    """One label is asked for nearly twice its rows, the other for half."""
    rows = f1(spark, sf)
    factor = F.when(F.col("label") == "real", F.count("*") * 2 - 1).otherwise(F.floor(F.count("*") / 2))
    return sampling.shortfall(rows, "label", rows.groupBy("label").agg(factor.alias("quota")))


@query("e4_group_top_up", with_(F2) + f"""
, d AS (SELECT sample_id, doc_key, {norm('transcript')} AS grp, source_dataset FROM f2),
 g AS (SELECT grp, count(*) AS size, arg_min(source_dataset, doc_key) AS dom FROM d GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY sha256('42|' || grp), grp) AS round FROM g),
 s AS (SELECT *, sum(size) OVER (ORDER BY round, dom) - size AS before FROM r),
 p AS (SELECT d.sample_id, round, before, row_number() OVER (PARTITION BY d.grp ORDER BY doc_key) AS pos FROM d JOIN s USING (grp) WHERE before < 700)
SELECT sample_id, round FROM p WHERE before + pos <= 700""")
def _(spark, sf):
    docs = f2(spark, sf).select("sample_id", "doc_key", "source_dataset", "transcript")
    picked = sampling.group_top_up(docs, clean.normalize_text("transcript"), "source_dataset", 700, ["doc_key"], strict=False)
    return picked.select("sample_id", "round")


@query("e4_group_top_up_speakers", with_(F1) + """
, g AS (SELECT speaker_id, count(*) AS size, arg_min(language_type, order_key) AS dom FROM f1 GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY sha256('42|' || speaker_id), speaker_id) AS round FROM g),
 s AS (SELECT *, sum(size) OVER (ORDER BY round, dom) - size AS before FROM r),
 p AS (SELECT sample_id, round, before, row_number() OVER (PARTITION BY f1.speaker_id ORDER BY order_key) AS pos FROM f1 JOIN s USING (speaker_id) WHERE before < 4321)
SELECT sample_id, round FROM p WHERE before + pos <= 4321""")
def _(spark, sf):
    rows = f1(spark, sf).select("sample_id", "order_key", "speaker_id", "language_type")
    return sampling.group_top_up(rows, "speaker_id", "language_type", 4321, ["order_key"], strict=False).select("sample_id", "round")


@query("e4_top_up_shortfall", with_(F2) + "SELECT count(*) + 29 AS wanted, count(*) AS got FROM f2")
def _(spark, sf):
    """Twenty-nine documents more are asked for than there are."""
    docs = f2(spark, sf)
    return sampling.shortfall(docs, [], docs.agg((F.count("*") + 29).alias("quota")))


@query("e5_quota_shortfall", with_(F3) + """
, s AS (SELECT generator, entity, count(*) AS n FROM f3 GROUP BY 1, 2)
SELECT generator, CAST(9000 AS BIGINT) AS wanted, CAST(sum(least(n, 50)) AS BIGINT) AS got FROM s GROUP BY 1 HAVING sum(least(n, 50)) < 9000""")
def _(spark, sf):
    """Entities may give fifty rows each."""
    return sampling.shortfall(f3(spark, sf), "generator", 9000, ("entity", 50))


@query("e5_capped_quota", with_(F3) + f"""
, a AS (SELECT *, row_number() OVER (PARTITION BY generator, entity ORDER BY {F3_ORDER_SQL}) AS entity_rank FROM f3),
 b AS (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY {F3_ORDER_SQL}) AS position FROM a WHERE entity_rank <= 120)
SELECT row_key, generator, entity_rank, position FROM b WHERE position <= 9000""")
def _(spark, sf):
    return sampling.capped_quota(f3(spark, sf), "entity", 120, 9000, "generator", F3_ORDER, strict=False) \
        .select("row_key", "generator", "entity_rank", "position")


@query("e6_escalating_cap", with_(F3) + f"""
, s AS (SELECT generator, entity, count(*) AS n FROM f3 GROUP BY 1, 2),
 c AS (SELECT generator, cap, i, sum(least(n, cap)) AS reach FROM s, (VALUES (30, 0), (60, 1), (120, 2), (240, 3), (400, 4)) c(cap, i) GROUP BY ALL),
 u AS (SELECT generator, coalesce(min(i) FILTER (WHERE reach >= 9999), 4) AS lvl FROM c GROUP BY 1),
 a AS (SELECT *, row_number() OVER (PARTITION BY generator, entity ORDER BY {F3_ORDER_SQL}) AS entity_rank FROM f3),
 t AS (SELECT *, CASE WHEN entity_rank <= 30 THEN 0 WHEN entity_rank <= 60 THEN 1 WHEN entity_rank <= 120 THEN 2 WHEN entity_rank <= 240 THEN 3 ELSE 4 END AS tier FROM a WHERE entity_rank <= 400),
 b AS (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY tier, {F3_ORDER_SQL}) AS pos FROM t JOIN u USING (generator) WHERE tier <= lvl)
SELECT row_key, generator, entity_rank, tier, [30, 60, 120, 240, 400][lvl + 1] AS cap_used FROM b WHERE pos <= 9999""")
def _(spark, sf):
    return sampling.escalating_cap(f3(spark, sf), "entity", 30, 9999, "generator", F3_ORDER, strict=False) \
        .select("row_key", "generator", "entity_rank", "tier", "cap_used")


@query("e6_cap_shortfall", with_(F3) + """
, s AS (SELECT generator, entity, count(*) AS n FROM f3 GROUP BY 1, 2)
SELECT generator, CAST(sum(n) AS BIGINT) AS wanted, CAST(sum(least(n, 40)) AS BIGINT) AS got FROM s GROUP BY 1 HAVING sum(least(n, 40)) < sum(n)""")
def _(spark, sf):
    """Every row of a generator is wanted, but no entity may give more than forty."""
    rows = f3(spark, sf)
    return sampling.shortfall(rows, "generator", rows.groupBy("generator").agg(F.count("*").alias("quota")), ("entity", 40))


@query("e7_initial_cap", with_(F3) + """
SELECT generator, count(DISTINCT entity) AS "groups", CAST(least(30, greatest(1, ceil(2500 / count(DISTINCT entity)))) AS INT) AS cap FROM f3 GROUP BY 1""")
def _(spark, sf):
    table_ = f3(spark, sf).groupBy("generator").agg(F.countDistinct("entity").alias("groups"))
    return table_.withColumn("cap", sampling.initial_cap(2500, "groups"))


@query("e8_quota_sample", with_(F3) + f"""
, b AS (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY {F3_ORDER_SQL}) AS position FROM f3)
SELECT row_key, generator, position FROM b JOIN (VALUES ('R', 2500), ('A', 700)) q(generator, quota) USING (generator) WHERE position <= quota""")
def _(spark, sf):
    quotas = spark.createDataFrame([("R", 2500), ("A", 700), ("Z", 9)], "generator string, quota int")
    return sampling.quota_sample(f3(spark, sf), "generator", quotas, F3_ORDER, strict=False).select("row_key", "generator", "position")


@query("e8_quota_shortfall", with_(F3) + """
SELECT q.generator, q.quota AS wanted, coalesce(n, 0) AS got FROM (VALUES ('R', 100000000), ('A', 7), ('Z', 9)) q(generator, quota)
LEFT JOIN (SELECT generator, count(*) AS n FROM f3 GROUP BY 1) USING (generator) WHERE coalesce(n, 0) < q.quota""")
def _(spark, sf):
    quotas = spark.createDataFrame([("R", 100_000_000), ("A", 7), ("Z", 9)], "generator string, quota int")
    return sampling.shortfall(f3(spark, sf), "generator", quotas)


@query("e9_arrival_capped_sample", with_(F1) + """
, v AS (SELECT sample_id, order_key, CASE WHEN order_key % 31 = 0 THEN 'UNKNOWN' ELSE speaker_id END AS speaker_id, order_key % 4 <> 3 AS has FROM f1),
 s AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY order_key) AS seen,
  CASE WHEN has THEN count(*) FILTER (WHERE has) OVER (PARTITION BY speaker_id ORDER BY order_key) END AS u FROM v),
 e AS (SELECT *, count(*) FILTER (WHERE u = 1) OVER (ORDER BY order_key) AS entities FROM s),
 p AS (SELECT *, row_number() OVER (ORDER BY order_key) AS position FROM e WHERE u = 1 OR (u > 1 AND seen <= greatest(1, ceil(2500 / entities))))
SELECT sample_id, speaker_id, seen, entities, position FROM p WHERE position <= 2500""")
def _(spark, sf):
    rows = f1(spark, sf).selectExpr("sample_id", "order_key", "CASE WHEN order_key % 31 = 0 THEN '' ELSE speaker_id END AS speaker_id",
                                    "CASE WHEN order_key % 4 <> 3 THEN file_path END AS payload")
    return sampling.arrival_capped_sample(rows, "speaker_id", 2500, ["order_key"], "payload", strict=False) \
        .select("sample_id", "speaker_id", "seen", "entities", "position")


@query("e9_arrival_shortfall", with_(F1) + """
, s AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY order_key) AS seen FROM f1),
 e AS (SELECT *, count(*) FILTER (WHERE seen = 1) OVER (ORDER BY order_key) AS entities FROM s),
 n AS (SELECT count(*) + 1 AS wanted FROM f1),
 p AS (SELECT count(*) AS got FROM e, n WHERE seen <= greatest(1, ceil(wanted / entities)))
SELECT wanted, got FROM n, p WHERE got < wanted""")
def _(spark, sf):
    """One row more than there are is asked for; how many the rule takes depends on it."""
    rows = f1(spark, sf).select("sample_id", "order_key", "speaker_id")
    return sampling.arrival_shortfall(rows, "speaker_id", rows.count() + 1, ["order_key"])


@query("e10_best_per_group", with_(PROFILE_SQL) + """
SELECT user_id, block, num_rows FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY num_rows DESC, file, block) AS rn FROM p) WHERE rn = 1""")
def _(spark, sf):
    placed = blocks.with_block_position(table(spark, sf, "events"), 50)
    sizes = placed.groupBy("user_id", "file", "block").agg(F.count("*").alias("num_rows"))
    return sampling.best_per_group(sizes, "user_id", "num_rows", ["file", "block"]).drop("file")


@query("e11_spread_evenly", with_(F1) + """
, o AS (SELECT sample_id, row_number() OVER (ORDER BY language_type, order_key) - 1 AS position FROM f1)
SELECT sample_id, position FROM o WHERE position IN (SELECT CAST(floor(i * ((SELECT count(*) FROM f1) / 160)) AS BIGINT) FROM range(160) r(i))""")
def _(spark, sf):
    rows = f1(spark, sf).select("sample_id", "language_type", "order_key")
    return sampling.spread_evenly(rows, ["language_type", "order_key"], 160).select("sample_id", "position")


@query("e12_dedup_keep_first", with_(F2) + f"""
SELECT sample_id FROM (SELECT sample_id, row_number() OVER (PARTITION BY {norm('transcript')} ORDER BY path, sample_id) AS rn FROM f2) WHERE rn = 1""")
def _(spark, sf):
    return sampling.dedup_keep_first(f2(spark, sf), clean.normalize_text("transcript"), ["path", "sample_id"]).select("sample_id")


@query("e12_dedup_report", with_(F2) + f"""
SELECT count(*) AS rows, count(DISTINCT {norm('transcript')}) AS kept, count(*) - count(DISTINCT {norm('transcript')}) AS removed FROM f2""")
def _(spark, sf):
    return sampling.dedup_report(f2(spark, sf), clean.normalize_text("transcript"))


@query("e17_deal_conditions", with_(F1, LICENSED, DEALT) + "SELECT sample_id, pos AS position, c AS augmentation_condition FROM dealt")
def _(spark, sf):
    return derive.deal_conditions(f1(spark, sf).where("split = 'train'")).select("sample_id", "position", "augmentation_condition")


@query("e18_cycle_params", with_(F1, LICENSED, DEALT) + "SELECT sample_id, params AS augmentation_parameters FROM dealt")
def _(spark, sf):
    dealt = derive.deal_conditions(f1(spark, sf).where("split = 'train'"))
    return dealt.select("sample_id", derive.cycle_params("augmentation_condition", "position").alias("augmentation_parameters"))


@query("e19_stratified_take", with_(F1) + """
SELECT sample_id, position FROM (SELECT *, row_number() OVER (PARTITION BY language_type, label ORDER BY sha256('43|' || sample_id), sample_id) AS position FROM f1)
WHERE position <= 100""")
def _(spark, sf):
    return sampling.stratified_take(f1(spark, sf), ["language_type", "label"], 100, strict=False).select("sample_id", "position")


@query("e19_stratified_take_many", with_(F1) + """
SELECT sample_id, position FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('43|' || sample_id), sample_id) AS position FROM f1)
WHERE position <= 3000""")
def _(spark, sf):
    return sampling.stratified_take(f1(spark, sf), ["label"], 3000, strict=False).select("sample_id", "position")


@query("e19_short_strata", with_(F1) + """
SELECT language_type, label, count(*) AS available FROM f1 GROUP BY 1, 2 HAVING count(*) < (SELECT count(*) / 4 FROM f1)""")
def _(spark, sf):
    """Strata with less than a quarter of all rows."""
    rows = f1(spark, sf)
    return sampling.shortfall(rows, ["language_type", "label"], rows.select("language_type", "label").distinct().withColumn(
        "quota", rows.agg(F.ceil(F.count("*") / 4)).scalar())).select("language_type", "label", F.col("got").alias("available"))


@query("e20_derive_manifest", with_(F1, LICENSED, AUGMENTED) + "SELECT * FROM aug")
def _(spark, sf):
    return derive.plan_train(licensed(spark, sf))


@query("e20_derive_robustness", with_(F1, LICENSED, ROBUSTNESS) + "SELECT * FROM rob")
def _(spark, sf):
    return derive.plan_robustness(licensed(spark, sf), strict=False)


@query("e21_top_values", with_(F1) + "SELECT session_id, count(*) AS n FROM f1 GROUP BY 1 ORDER BY n DESC, session_id LIMIT 15")
def _(spark, sf):
    from sievewright.operators.counts import top_values
    return top_values(f1(spark, sf), "session_id", 15)
