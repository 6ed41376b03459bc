"""Line de-duplication by a suffix array over line identifiers. DataFrame functions only.

A text is the sequence of its lines; blank lines take no part and always stay. The
suffixes of all texts are sorted by prefix doubling: a suffix's rank after round k orders
it by its first 2^k lines, and round k + 1 sorts by the pair (rank, rank of the
suffix 2^k lines on). Suffixes of equal rank form a longest-common-prefix interval of depth
2^k or more, a repeated run of lines. A suffix that no other shares its prefix with
leaves, for no deeper interval can hold it; so do suffixes that end. Rounds go on until
no interval is left, and each is written to the shared folder.

In an interval the suffix of the smallest (id, hash of the text, position) is the first; the
others are later copies. A line is deleted if it lies in a later copy of a run of
`min_lines` lines or more (a power of two).

Intervals are aggregated and joined, never gathered, so a line that a third of all
documents share is no hot task. Null and empty texts have no lines and stay as they
are. Repeated rows (same id, same text) are one document: each keeps what it keeps. A null
id sorts first. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievewright.operators.running import running_sums
from sievewright.session import settled

MIN_LINES = 1
LINE_BREAK, WORDS = "\n", "[^\\x20\\x09-\\x0D]"

_PLACE = ["doc", "text_key", "pos"]


def _keys(text: str, id_col: str) -> list[Column]:
    return [F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_key")]


def _filled(line: Column) -> Column:
    return line.rlike(WORDS)


def line_table(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(doc, text_key, pos, line_id) of every line that is not blank; line_id is a digest, pos counts such lines."""
    lines = F.filter(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), LINE_BREAK), _filled)
    return docs.select(*_keys(text, id_col), F.posexplode(lines).alias("pos", "line")).select(
        *_PLACE, F.unhex(F.md5("line")).alias("line_id"))


def _place() -> Column:
    return F.struct(*_PLACE)


def _next_level(sorted_by: DataFrame, by: list[str], ranked: DataFrame) -> DataFrame:
    """Suffixes of the intervals in `ranked`, with their new rank and whether they are a later copy."""
    return sorted_by.join(ranked, by).select(
        *_PLACE, F.col("new_rank").alias("rank"), (_place() != F.col("first")).alias("later"))


def _intervals(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, first) of groups with more than one place; repeated rows have one place."""
    return suffixes.groupBy(*by).agg(F.count("*").alias("n"), F.min(_place()).alias("first"), F.max(_place()).alias("last")) \
        .where("n > 1 AND first <> last").drop("last")


def levels(docs: DataFrame, text: str = "text", id_col: str = "doc_id"):
    """Yield (depth, suffixes): (doc, text_key, pos, rank, later) of all intervals of that depth."""
    lines = settled(line_table(docs, text, id_col), "lines")
    first = _intervals(lines, ["line_id"]).withColumn("key", F.hex("line_id"))
    ranked = running_sums(first, [], ["key"], {"upto": F.col("n")}, hashed=True)
    ranked = ranked.join(first.select("line_id", "n"), "line_id") if "n" not in ranked.columns else ranked
    active = settled(_next_level(lines, ["line_id"], ranked.withColumn("new_rank", F.col("upto") - F.col("n"))).distinct(), "suffixes")
    depth = 1
    while not active.isEmpty():
        yield depth, active
        after = active.select("doc", "text_key", (F.col("pos") - depth).alias("pos"), F.col("rank").alias("rank2"))
        here = active.select(F.col("doc").alias("d"), F.col("text_key").alias("t"), F.col("pos").alias("p"), "rank")
        pairs = settled(after.join(here, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")) & (F.col("pos") == F.col("p")))
                        .select(*_PLACE, "rank", "rank2"), "pairs")
        ranked = running_sums(_intervals(pairs, ["rank", "rank2"]), ["rank"], ["rank2"], {"upto": F.col("n")})
        active = settled(_next_level(pairs, ["rank", "rank2"], ranked.withColumn("new_rank", F.col("rank") + F.col("upto") - F.col("n"))), "suffixes")
        depth *= 2


def copied_lines(docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, text_key, removed, run_depth) of documents with later copies.

    removed: sorted positions of the lines to delete; run_depth: the largest power of two
    so that as many consecutive lines of the document start earlier elsewhere.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines is a power of two")
    found = []
    for depth, suffixes in levels(docs, text, id_col):
        none = F.array(F.lit(None).cast("int"))
        lines = F.sequence(F.col("pos"), F.col("pos") + (min_lines - 1)) if depth == min_lines else none
        found.append(suffixes.where("later").select("doc", "text_key", F.explode(lines).alias("pos"), F.lit(depth).cast("long").alias("depth")))
    if not found:
        return docs.select(*_keys(text, id_col), F.array().cast("array<int>").alias("removed"), F.lit(0).cast("long").alias("run_depth")).limit(0)
    marks = found[0]
    for more in found[1:]:
        marks = marks.unionByName(more)
    return marks.groupBy("doc", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("removed"), F.max("depth").alias("run_depth"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns of `docs`, with later copies cut out of the text, and __n_lines, __n_removed, __n_runs, __longest_run, __run_depth.

    Lines count without blank ones. A run here is a stretch of deleted lines with nothing but blank lines between.
    """
    marks = settled(copied_lines(docs, min_lines, text, id_col), "marks").withColumnsRenamed(
        {"doc": "__doc", "text_key": "__key", "removed": "__gone", "run_depth": "__depth"})
    whole = F.col(f"`{text}`")
    keyed = docs.withColumn("__k", F.xxhash64(F.coalesce(whole, F.lit(""))))
    joined = keyed.join(marks, F.col(f"`{id_col}`").eqNullSafe(F.col("__doc")) & (F.col("__k") == F.col("__key")), "left")
    lines = F.split(F.coalesce(whole, F.lit("")), LINE_BREAK)
    filled = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: _filled(F.get("__lines", i)))
    gone = F.transform("__removed", lambda o: F.get("__filled", o))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone)
    starts = F.filter("__removed", lambda o, i: (i == 0) | (F.get("__removed", i - 1) != o - 1))
    ends = F.filter("__removed", lambda o, i: (i == F.size("__removed") - 1) | (F.get("__removed", i + 1) != o + 1))
    longest = F.array_max(F.zip_with(starts, ends, lambda a, b: b - a + 1))
    arrays = joined.withColumn("__removed", F.coalesce("__gone", F.array().cast("array<int>"))) \
        .withColumn("__lines", lines).withColumn("__filled", filled)
    touched = F.size("__removed") > 0
    return arrays.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text],
        F.when(touched, F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), LINE_BREAK)).otherwise(whole).alias(text),
        F.size("__filled").cast("long").alias("__n_lines"), F.size("__removed").cast("long").alias("__n_removed"),
        F.size(ends).cast("long").alias("__n_runs"), F.coalesce(longest, F.lit(0)).cast("long").alias("__longest_run"),
        F.coalesce("__depth", F.lit(0)).cast("long").alias("__run_depth"))


def line_report(docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, longest_run, run_depth, kept_sha256), one row a document."""
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return dedup_lines(named, min_lines).select(
        "doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_lines", "n_removed", "n_runs", "longest_run", "run_depth")],
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
