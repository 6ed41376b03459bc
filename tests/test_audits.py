"""Audits, gates, joins and sources on hand-made edge cases."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievewright.functions import signal
from sievewright.operators import conform, counts, gates, joins, shortcuts, signals
from sievewright.plans import jobs
from sievewright.session import scratch_path
from sievewright.sources import blocks, files, manifests


def one(df):
    return df.collect()[0].asDict()


def test_fingerprint_spreads_missing_and_repeated_ids(spark):
    """Ids that are missing or equal do not share a leaf, and a missing id is not the empty one."""
    rows = [(None, f"h{k}") for k in range(300)] + [("same", f"h{k}") for k in range(300)] + [("a:1", "2"), ("a", "1:2")]
    df = spark.createDataFrame(rows, "id string, h string")
    first = one(gates.fingerprint(df, "id", "h"))
    assert first["rows"] == 602 and one(gates.fingerprint(df.repartition(5), "id", "h")) == first
    for other in ([("", "h0")] + rows[1:], rows[:-1] + [("a:1", "2")], rows + rows[:1]):
        assert one(gates.fingerprint(spark.createDataFrame(other, "id string, h string"), "id", "h"))["fingerprint"] != first["fingerprint"]


def test_tree_fingerprint_sees_any_change(spark):
    base = spark.range(500).selectExpr("CAST(id AS STRING) AS id", "'h' || id AS h")
    first = one(gates.fingerprint(base, "id", "h"))
    assert one(gates.fingerprint(base.repartition(9, "h"), "id", "h")) == first
    changed = base.withColumn("h", F.when(F.col("id") == "77", "x").otherwise(F.col("h")))
    assert one(gates.fingerprint(changed, "id", "h"))["fingerprint"] != first["fingerprint"]


def test_feature_of_one_class_is_perfect_but_unassociated(spark):
    df = spark.createDataFrame([("real", None), ("fake", "x"), ("fake", "y"), ("real", " ")], "label string, f string")
    row = one(shortcuts.shortcut_audit(df, {"f": "f"}))
    assert (row["n"], row["majority_accuracy"], row["cramers_v"], row["verdict"]) == (2, 1.0, 0.0, "PERFECT SHORTCUT")


def test_single_valued_feature(spark):
    df = spark.createDataFrame([("real", "k"), ("fake", "k"), ("fake", "k")], "label string, f string")
    row = one(shortcuts.shortcut_audit(df, {"f": "f"}))
    assert (row["cramers_v"], row["shared_values"], row["verdict"]) == (0.0, 1, "weak/none")
    assert one(shortcuts.cramers_v(df, "f")) == {"n": 3, "cramers_v": 0.0}


def test_perfect_association(spark):
    df = spark.createDataFrame([("real", "a"), ("fake", "b")] * 5, "label string, f string")
    assert one(shortcuts.cramers_v(df, "f"))["cramers_v"] == 1.0


def test_threshold_and_auc_brute_force(spark, small_cells):
    rows = [("fake" if (i * 37) % 11 < 5 else "real", float((i * 53) % 17)) for i in range(90)]
    df = spark.createDataFrame(rows, "label string, v double")
    p = [v for l, v in rows if l == "fake"]
    q = [v for l, v in rows if l == "real"]
    auc = sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))
    best = max(max(sum((v > t) == (l == "fake") for l, v in rows), sum((v <= t) == (l == "fake") for l, v in rows))
               for t in [v for _, v in rows] + [-1]) / len(rows)
    row = one(shortcuts.best_threshold(df, "v"))
    assert row["auc"] == pytest.approx(auc, abs=1e-6) and row["best_accuracy"] == pytest.approx(best, abs=1e-6)


def test_one_label_has_no_auc(spark):
    df = spark.createDataFrame([("fake", 1.0), ("fake", 2.0)], "label string, v double")
    row = one(shortcuts.best_threshold(df, "v"))
    assert row["auc"] is None and row["best_accuracy"] == 1.0


def test_declared_rate_unparsable_is_a_mismatch(spark):
    df = spark.createDataFrame([("x", 16000, "1.0", 1.0), ("16000.0", 16000, "bad", 1.0), (None, 16000, "1.2", 1.0)],
                               "declared_sample_rate string, original_sample_rate int, declared_duration string, duration double")
    assert one(counts.declared_vs_actual(df)) == {"rates_compared": 2, "rate_mismatch": 1, "durations_compared": 3, "duration_mismatch": 1}


def test_duplicates_count_null_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), (None,), ("b",)], "k string")
    assert one(counts.duplicate_rows(df, "k")) == {"repeated_values": 2, "members": 5, "surplus": 3}
    assert one(counts.duplicate_rows(df, "k", drop_null=True)) == {"repeated_values": 1, "members": 2, "surplus": 1}
    assert one(df.agg(gates.surplus("k").alias("s"))) == {"s": 3}


def test_forbid_and_refusal(spark):
    clean = spark.createDataFrame([("1", "abc")], "sample_id string, group_id string")
    conform.assert_publishable(clean)
    for bad in (clean.withColumn("speaker_id", F.lit("7")), clean.withColumn("group_id", F.lit("s::7")),
                clean.withColumn("path", F.lit("C:\\Users\\me\\x.wav"))):
        with pytest.raises(ValueError):
            conform.assert_publishable(bad)


def test_min_available(spark):
    assert conform.min_available(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        conform.min_available(spark.range(4), 5)


def test_usable_filter_reports_the_dropped(spark):
    from pyspark.sql import Observation
    seen = Observation("usable")
    df = spark.createDataFrame([("a", 1.0), ("b", 30.0), (None, 5.0), ("c", 31.0), ("d", None)], "t string, d double")
    assert conform.usable_filter(df, ["t"], "d", 1, 30, seen).count() == 2
    assert seen.get["dropped"] == 3


def test_cross_label_pairs(spark):
    df = spark.createDataFrame([("A b", "real", "train"), ("a  B", "fake", "test"), ("a b", "fake", "train"), ("z", "real", "test")],
                               "transcript string, label string, split string")
    row = one(joins.cross_label_text(df))
    assert (row["real_rows"], row["fake_rows"], row["cross_split_pairs"]) == (1, 2, 1)


def test_interval_edges(spark):
    frames = spark.range(10).selectExpr("'r' AS recording", "id AS frame", "id * 1.0D AS value")
    segments = spark.createDataFrame([("a", "r", 0.0, 0.35, 10), ("empty", "r", 0.5, 0.5, 10), ("past", "r", 0.8, 9.0, 10), ("beyond", "r", 5.0, 6.0, 10)],
                                     "segment_id string, recording string, start_time double, end_time double, rate int")
    cut = joins.slice_intervals(segments, frames, 4)
    got = {r.segment_id: (r.frames, r.empty_span) for r in joins.slice_report(segments, cut).collect()}
    assert got == {"a": (4, False), "empty": (0, True), "past": (2, False), "beyond": (0, True)}


def test_empty_split_modes(spark):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "source_dataset string, split string")
    assert counts.empty_splits(df).count() == 4
    assert counts.empty_splits(df, skip_absent=True).count() == 2


def test_check_current_counts_copies(spark):
    fresh = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    assert one(joins.check_current(fresh, fresh))["current"]
    assert one(joins.check_current(fresh, fresh.distinct())) == {"missing": 1, "out_of_date": 0, "current": False}


def test_purge_only_when_tainted(spark):
    df = spark.createDataFrame([("real", "a"), ("real", "b"), ("fake", "a"), (None, "a")], "label string, upstream_dataset string")
    assert joins.conditional_purge(df, "real", ["b"]).count() == 2
    assert joins.conditional_purge(df, "real", ["c"]).count() == 4


# ---- signals ----

def test_silence_and_floor(spark):
    df = spark.createDataFrame([("z", i, 0.0) for i in range(4)] + [("q", 0, 0.0), ("q", 1, 0.5), ("q", 2, 0.0), ("q", 3, 0.0)],
                               "recording string, frame int, value double")
    level = {r.recording: r.rms_dbfs for r in signals.rms_dbfs(df).collect()}
    assert level["z"] == -240.0 and level["q"] == pytest.approx(20 * math.log10(0.25), abs=1e-6)
    edges = {r.recording: (r.leading_s, r.trailing_s) for r in signals.edge_silence(df, 0.1, 1.0).collect()}
    assert edges == {"z": (4.0, 4.0), "q": (1.0, 2.0)}
    dead = signals.dead_signal(signals.features(df, 0.1, 0.99, 1.0), 0.01, -60).collect()
    assert [(r.recording, r.verdict) for r in dead] == [("z", "zeros")]


def test_quiet_signal_survives_mild_clipping(spark):
    df = spark.createDataFrame([([1000.0, -2000.0, 15000.0],), ([20000.0, -30000.0],)], "w array<double>")
    rows = df.select("w", signal.mild_clipping("w").alias("c")).collect()
    assert rows[0].c == rows[0].w
    assert max(abs(v) for v in rows[1].c) < 30000


def test_windows_drop_the_tail(spark):
    df = spark.createDataFrame([([float(i) for i in range(7)],), ([1.0],)], "w array<double>")
    got = [r.x for r in df.select(signal.fixed_windows("w", 3).alias("x")).collect()]
    assert got == [[[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]], []]


# ---- sources ----

def test_string_manifest_keeps_blank_and_text(spark):
    rows = [("1", "", 'say "hi", ok'), ("2", "x", "two\nlines"), ("3", "NA", "back\\slash")]
    path = scratch_path(spark, "csv")
    manifests.write_manifest(spark.createDataFrame(rows, "sample_id string, a string, b string"), path, fmt="csv")
    assert sorted(tuple(r) for r in manifests.read_manifest(spark, path, multiline=True).collect()) == rows


def test_required_columns(spark):
    path = scratch_path(spark, "tsv")
    spark.createDataFrame([("a", "b")], "path string, sentence string").write.options(header=True, sep="\t").csv(path)
    assert manifests.read_tsv(spark, path, ["path"]).count() == 1
    with pytest.raises(ValueError, match="client_id"):
        manifests.read_tsv(spark, path, ["path", "client_id"])


def test_keyed_text_last_line_wins(spark):
    path = scratch_path(spark, "keyed")
    lines = ["a one", "b  two words ", "lonely", "", "a three"]
    spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.text(path)
    assert {r.key: r.value for r in manifests.read_keyed_text(spark, path).collect()} == {"a": "three", "b": "two words"}


def test_inventory_and_sniffing(spark, tmp_path):
    header = b"RIFF\x24\x00\x00\x00WAVEfmt \x10\x00\x00\x00\x01\x00\x02\x00\x80\xbb\x00\x00\x00\x00\x00\x00\x04\x00\x10\x00data"
    for name, content in (("a.wav", header), ("b.wav", b"fLaCxxxx"), ("c.mp3", b"ID3\x03rest"), ("d.bin", b"")):
        (tmp_path / name).write_bytes(content)
    found = files.file_inventory(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    assert {r.name: r.sha256 for r in found.collect()}["a.wav"] == hashlib.sha256(header).hexdigest()
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select(
        F.regexp_extract("path", "([^/]*)$", 1).alias("name"), files.sniff_container("content").alias("s"))
    got = {r.name: tuple(r.s) for r in raw.collect()}
    assert got == {"a.wav": ("wav", 48000, 2, 16), "b.wav": ("flac", None, None, None),
                   "c.mp3": ("mp3", None, None, None)}


def test_probing_paths_sees_empty_and_missing_files(spark, tmp_path):
    (tmp_path / "full").write_bytes(b"x" * 3_000_000)
    (tmp_path / "empty").write_bytes(b"")
    listed = spark.createDataFrame([(str(tmp_path / n),) for n in ("full", "empty", "gone")], "path string")
    got = {r.path.rsplit("/", 1)[1]: (r.exists, r.length, r.sha256) for r in files.probe_paths(listed, tasks=2).collect()}
    assert got == {"full": (True, 3_000_000, hashlib.sha256(b"x" * 3_000_000).hexdigest()),
                   "empty": (True, 0, hashlib.sha256(b"").hexdigest()), "gone": (False, 0, None)}
    state = gates.verify_hashes(listed.withColumn("sha256", F.lit("")), files.probe_paths(listed).where("exists"), "path")
    assert sorted(r.state for r in state.collect()) == ["missing", "verified", "zero_byte"]


def test_scan_reads_only_wanted_columns(spark):
    df = manifests.scan_columns(spark, "/root/testdata/sf0.001/documents.parquet", ["doc_id", "lang", "nope"])
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in df._jdf.queryExecution().executedPlan().toString()


def test_block_purity(spark):
    path = scratch_path(spark, "blocks")
    spark.createDataFrame([("x", "1"), ("x", "1"), ("x", "2"), ("y", "2")], "g string, e string").coalesce(1).write.parquet(path)
    profile = blocks.block_profile(blocks.with_block_position(spark.read.parquet(path), 2), ["g", "e"]).orderBy("block").collect()
    assert [(r.num_rows, r.pure_g, r.pure_e, r.pure) for r in profile] == [(2, True, True, True), (2, False, True, False)]


@pytest.mark.parametrize("join", [
    lambda d, t: joins.merge_results(d, t, "k"), lambda d, t: joins.apply_assignment(d, t.withColumn("new_split", F.lit("s")), "k"),
    lambda d, t: conform.attach_lookup(d, "k", t, {"v": "none"}),
    lambda d, t: gates.verify_hashes(d.withColumn("path", F.col("k")).withColumn("sha256", F.lit("")),
                                     t.select(F.col("k").alias("path"), F.lit(1).alias("length"), F.lit("h").alias("sha256")), "k")])
def test_repeated_keys_are_refused(spark, join):
    rows = spark.createDataFrame([("a", "t"), ("b", "t"), (None, "t")], "k string, split string")
    once = spark.createDataFrame([("a", "1"), ("c", "2"), (None, "3"), (None, "4")], "k string, v string")
    assert join(rows, once).count() == 3
    with pytest.raises(Exception, match="repeated key"):
        join(rows, once.union(spark.createDataFrame([("a", "5")], "k string, v string"))).collect()


def test_independent_audit_reads_whole_tables(spark):
    """Holes in the path lists of coverage hide nothing from the other parts."""
    docs = spark.createDataFrame([("p0", "said twice", "real", "train", "s", 3, "h0"), ("p5", "Said  twice", "fake", "test", "s", 3, "h0"),
                                  ("p1", "once", "real", "train", "s", 4, "h1")],
                                 "path string, transcript string, label string, split string, source_dataset string, bytes long, sha256 string")
    sounds = spark.createDataFrame([("real", 0.1, 0.2, 0.3, 0.4), ("fake", 0.2, 0.1, 0.4, 0.3)],
                                   "label string, peak double, rms_dbfs double, leading_s double, trailing_s double")
    inventory = docs.select("path", F.col("bytes").alias("length"), "sha256", F.col("source_dataset").alias("collection"))
    report = jobs.independent_audit(docs, inventory, sounds, docs.where("path <> 'p5'").select("path"), docs.where("path <> 'p0'").select("path"))
    found = {(r["metric"], r["item"]): r["value"] for r in report.collect() if r["metric"] != "threshold"}
    assert [found["coverage", i] for i in ("matched", "referenced_but_missing", "on_disk_but_unlabelled")] == ["1", "1", "1"]
    assert (found["duplicates", "groups"], found["duplicates", "redundant"]) == ("1", "1")
    assert (found["text reuse", "clips"], found["text reuse", "max_reuse"]) == ("3", "2")
    assert (found["cross-label texts", "texts"], found["cross-label texts", "pairs"]) == ("1", "1")


def test_whole_audit_query_sees_every_document(spark):
    sf = "/root/testdata/sf0.001"
    report = entry.queries()["i12_independent_audit_whole"](spark, sf).where("metric = 'text reuse' AND item = 'clips'")
    assert one(report.agg(F.sum(F.col("value").cast("long")).alias("n")))["n"] == spark.read.parquet(f"{sf}/documents.parquet").count()
