"""Scalar cleaning on hand-made edge rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from sievewright.functions import clean


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r.x for r in df.select("i", column("v").alias("x")).orderBy("i").collect()]


def test_blank_to_null_strips_unicode_space(spark):
    assert values(spark, [" a\u00a0", "\t\u2003\n", "", None, "\x1cb"], clean.blank_to_null) == ["a", None, None, None, "b"]


def test_numeric_id(spark):
    assert values(spark, ["1087.0", "1087", " 1087 ", "1087.000", "10.5", "x1.0", None], clean.normalize_numeric_id) == [
        "1087", "1087", "1087", "1087", "10.5", "x1.0", None]


def test_alias(spark):
    assert values(spark, ["XTTS-V2", "xttsv2", " FreeVC 24", "vits", "Other-Tool", None], clean.normalize_alias) == [
        "xtts_v2", "xtts_v2", "freevc24", "vits", "other_tool", None]


def test_category(spark):
    assert values(spark, ["Female", "FEMALE", " male_masculine ", "nan", "None", "", None, "other"], clean.normalize_category) == [
        "female", "female", "male", "unknown", "unknown", "unknown", "unknown", "unknown"]


def test_normalize_text_equals_python(spark):
    rows = ["  Hello\u00a0 World\t\n", "ÀÉ  x", "", "a\x1fb", "\u3000tab\u2028sep", None]
    want = [None if r is None else " ".join(r.lower().split()) for r in rows]
    assert values(spark, rows, clean.normalize_text) == want


def test_strict_text_is_nfkc_without_punctuation(spark):
    rows = ["Ｆｕｌｌ　width!", "ﬁne, print.", "नमस्ते। दुनिया", "a—b … c", None]

    def want(r):
        plain = unicodedata.normalize("NFKC", r)
        return " ".join("".join(c for c in plain if not unicodedata.category(c).startswith("P")).lower().split())
    assert values(spark, rows, clean.normalize_text_strict) == [None if r is None else want(r) for r in rows]


def test_code_switch_devanagari(spark):
    rows = ["नमस्ते world", "नमस्ते", "world", "", None]
    assert values(spark, rows, clean.is_code_switched) == [True, False, False, False, False]
    assert values(spark, rows, clean.script_class) == ["code_switched", "devanagari", "latin", "latin", "latin"]


def test_paths(spark):
    rows = ["./../a/b", "a\\b\\c.wav", "..//x", "/abs/y", None]
    assert values(spark, rows, clean.relativize_path) == ["a/b", "a/b/c.wav", "x", "abs/y", None]
    assert values(spark, ["/home/x/hi/wavs/1.wav", "none"], lambda c: clean.path_tail(c, "hi/wavs/")) == ["hi/wavs/1.wav", None]
    assert values(spark, ["hi/d/1.wav", "1.wav"], clean.path_bucket) == ["d", "root"]


def test_bins_are_left_closed(spark):
    rows = ["0", "0.99", "1", "3", "19.99", "20", "-1", "x", "NaN", None]
    assert values(spark, rows, clean.bin_numeric) == [
        "<1s", "<1s", "1-2s", "3-5s", "12-20s", ">20s", "nan", "nan", "nan", "nan"]


def test_bit_depth_first_match_wins(spark):
    rows = ["WAV/PCM_16", "FLAC/PCM_24", "WAV/FLOAT", "MP3/MPEG_LAYER_III", "OGG/OPUS", "wav/pcm_16", None]
    assert values(spark, rows, clean.bit_depth) == [
        "16-bit PCM", "24-bit PCM", "32-bit", "lossy (MP3)", "lossy (Opus/Vorbis)", "other", "other"]


def test_hash_of_null_is_hash_of_empty(spark):
    import hashlib
    want = hashlib.sha256(b"salt|").hexdigest()[:16]
    assert values(spark, [None, ""], lambda c: clean.salted_hash(c, "salt")) == [want, want]


@pytest.mark.parametrize("status,flag", [("UNVERIFIED", "false"), ("unverified", "false"), ("VERIFIED", "true"), (None, "true")])
def test_redistribution(spark, status, flag):
    assert values(spark, [status], clean.redistribution_flag) == [flag]


def test_decompose_and_template(spark):
    df = spark.createDataFrame([("844424930703439-329-f.m4a",), ("cv_hi_00012",)], "v string")
    rows = df.select(*clean.decompose_id("v"), clean.name_template("v").alias("t")).collect()
    assert tuple(rows[0]) == ("844424930703439", "329", "f", True, "#-#-f.m#a")
    assert tuple(rows[1]) == (None, None, None, False, "cv_hi_#")


def test_composite_group_id(spark):
    df = spark.createDataFrame([("a", " 7 ", "X"), ("b", "7", " Some  TEXT ")], "s string, speaker string, transcript string")
    got = df.select(clean.composite_group_id("s", {"b": "transcript"}, "speaker").alias("g")).collect()
    assert [r.g for r in got] == ["a::7", "b::some text"]
    assert df.select(F.col("s")).count() == 2
