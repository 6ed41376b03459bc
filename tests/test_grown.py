"""Queries against their SQL on tables that hold what only larger ones do."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import checker
from catalog import fixtures, streams
from sievewright.operators import counts, splits
from sievewright.plans import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def changed(tmp_path):
    """A function: the folder of the smallest tables, some of them replaced by the result of SQL over them."""
    def make(**tables):
        con = checker.connect(SF)
        for t in checker.TABLES:
            if t in tables:
                con.execute(f"COPY ({tables[t]}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            else:
                os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
        return str(tmp_path)
    return make


def agrees(spark, sf, name):
    return checker.difference(checker.connect(sf), entry.queries()[name](spark, sf), entry.oracle_sql()[name]) is None


# two pages of one url: of other texts, and of the same text
REPEATED = "SELECT page_id, CASE WHEN page_id % 5 < 2 THEN 'http://u/' || page_id // 5 ELSE url END AS url, CASE WHEN page_id % 10 = 1 THEN 'same' WHEN page_id % 10 = 0 THEN 'same' ELSE html END AS html FROM pages"


def test_pages_of_one_url_are_probed_apart(spark, changed):
    assert agrees(spark, changed(pages=REPEATED), "a10_probe_paths")


def test_only_the_listed_page_of_a_url_counts(spark, changed):
    docs = "SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN 'src3' ELSE 'src1' END AS source) FROM documents"
    assert agrees(spark, changed(pages=REPEATED, documents=docs), "d22_artifact_hashes")


def test_doubles_in_reports_are_plain_texts(spark):
    values = [0.0, 6e-4, -3e-4, 1e-4, 0.001, 1.25, 9999999.5, 1e7, 12345678.9, -1234567890.123457, 99e-6, 1e-5, 1.2e-5, 1e-6, 4e-7, 123456789012345.6, None]
    found = jobs.tidy(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double"), "m", ["i"], ["v"])
    wanted = checker.connect(SF).execute("SELECT CAST(round(v, 6) AS VARCHAR) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
    assert [r.value for r in sorted(found.collect(), key=lambda r: int(r.scope))] == [w for w, in wanted]


MANY_SPEAKERS = dict(
    customer="SELECT c.* REPLACE (c_custkey + 1000000 * g AS c_custkey) FROM customer c, range(400) r(g)",
    orders="SELECT o.* REPLACE (o_orderkey + 10000000 * g AS o_orderkey, o_custkey + 1000000 * g AS o_custkey) FROM orders o, range(400) r(g)")


@pytest.mark.parametrize("name", ["d25_entity_sketches", "d30_shared_sketches"])
def test_sketches_stay_exact_beyond_their_entries(spark, changed, name):
    assert agrees(spark, changed(**MANY_SPEAKERS), name)


def test_hours_and_means_of_halves_do_not_go_by_chance(spark):
    rows = spark.range(0, 90, 1, 1).selectExpr("CAST(0.0017 AS DOUBLE) AS duration")       # 0.153 s are 42.5 millionths of an hour
    assert counts.duration_summary(rows, []).first().hours == 43e-6
    odd = counts.duration_summary(rows.selectExpr("duration * -1 AS duration").unionAll(spark.sql("SELECT double('nan')")), []).first()
    assert odd.hours != odd.hours and odd.mean_s != odd.mean_s
    assert counts.duration_summary(rows.selectExpr("-duration AS duration"), []).first().hours == -43e-6


def test_parts_of_a_stream_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(0, 1000, 1, 4).selectExpr("id AS l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(streams, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")      # a task a file
    try:
        list(streams._in_parts(spark, str(tmp_path), "lineitem", 2, F.col("l_orderkey") % 2))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len([f for f in os.listdir(f"{tmp_path}/lineitem-parts") if f.endswith(".parquet")]) == 8


def test_licences_are_joined_without_a_shuffle_by_source(spark):
    plan = fixtures.licensed(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 4


@pytest.mark.parametrize("block", ["3", "100000"])
def test_groups_are_placed_by_score_and_lacking_values_are_supplied(spark, block):
    """The sequential placement, in small blocks as well; 'c' is so rare that only the last pass brings it to every split."""
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(40):02d}", rng.choice("ab")) for _ in range(500)]
    held = Counter(rows)
    shares, totals = {"train": 70, "validation": 15, "test": 15}, Counter(a for _, a in rows)
    load, want = {s: Counter() for s in shares}, {}
    for g in sorted({g for g, _ in rows}, key=lambda g: (-held[g, "a"] - held[g, "b"], held[g, "a"], held[g, "b"], g)):
        def score(s):
            gap = {a: totals[a] * shares[s] - 100 * load[s][a] for a in "ab"}
            fit, over = (sum(f(a) for a in "ab") for f in (lambda a: min(100 * held[g, a], max(0, gap[a])), lambda a: max(0, 100 * held[g, a] - gap[a])))
            return 2 * fit - over, -sum(load[s].values())
        want[g] = max(shares, key=score)
        load[want[g]].update({a: held[g, a] for a in "ab"})
    spark.conf.set("sievewright.fold.rows", block)
    try:
        df = spark.createDataFrame(rows, "g string, a string")
        assert {r.group_key: r.new_split for r in splits.greedy_split_multi(df, "g", "a", ["a", "b"]).collect()} == want
        rare = df.unionAll(spark.createDataFrame([(f"q{i}", "c") for i in range(3)], "g string, a string"))
        got = {r.group_key: r.new_split for r in splits.greedy_split_multi(rare, "g", "a", ["a", "b", "c"]).collect()}
        assert {got[f"q{i}"] for i in range(3)} == set(shares)
    finally:
        spark.conf.unset("sievewright.fold.rows")
