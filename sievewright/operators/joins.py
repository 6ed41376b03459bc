"""Joins between manifests, ledgers, inventories and external sets.

No side is forced to broadcast: Spark does so from measured sizes, and splits
skewed partitions of the other joins at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sievewright import fixed_values as fixed
from sievewright.functions import clean
from sievewright.functions.keys import col, text
from sievewright.operators.guards import once


def assemble_segments(segments: DataFrame, texts: DataFrame, speakers: DataFrame, wavs: DataFrame) -> DataFrame:
    """Segments with transcript, speaker and wave name; inputs have unique keys."""
    return (segments.join(texts, "utt_id", "left").join(speakers, "utt_id", "left")
            .join(wavs, "recording_id", "left")
            .withColumn("duration", F.bround(F.col("end_time") - F.col("start_time"), 3)))


def unmatched_counts(assembled: DataFrame) -> DataFrame:
    return assembled.agg(
        F.count("*").alias("segments"),
        F.count_if(F.col("speaker_id").isNull()).alias("no_speaker"),
        F.count_if(F.col("transcript").isNull()).alias("no_transcript"),
        F.count_if(F.col("wav_name").isNull()).alias("no_wav"))


def existing_only(df: DataFrame, inventory: DataFrame, path: str = "path", nonempty: bool = True) -> DataFrame:
    present = inventory.where(F.col("length") > 0) if nonempty else inventory
    return df.join(present.select(path), path, "left_semi")


def in_catalogue(df: DataFrame, files: DataFrame, texts: DataFrame,
                 file_key: str = "file_name", text_key: str = "utt_id") -> DataFrame:
    return df.join(files.select(file_key), file_key, "left_semi").join(texts, text_key)


def not_seen(df: DataFrame, existing: DataFrame, text_col: str = "transcript") -> DataFrame:
    """Rows whose normalised text does not occur in `existing`."""
    seen = existing.select(clean.text_digest(text_col).alias("__text"))
    return df.join(seen, clean.text_digest(df[text_col]) == F.col("__text"), "left_anti")


def not_processed(df: DataFrame, ledger: DataFrame, keys) -> DataFrame:
    return df.join(ledger.select(*keys), list(keys), "left_anti")


def apply_assignment(df: DataFrame, assignment: DataFrame, key: str, only: Column | None = None,
                     split: str = "split") -> DataFrame:
    """Set the split from `(key, new_split)`, for the rows in `only`; others keep theirs."""
    joined = df.join(once(assignment.select(key, "new_split"), key), key, "left")
    new = F.coalesce(F.col("new_split"), F.col(split))
    return joined.withColumn(split, F.when(only, new).otherwise(F.col(split)) if only is not None else new) \
        .drop("new_split")


def merge_results(df: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results beside the rows they belong to; a key with two results is an error."""
    return df.join(once(results, key), key, "left")


def check_inheritance(child: DataFrame, parent: DataFrame, allowed: str) -> DataFrame:
    """Counts of every broken inheritance rule between a derived manifest and its parents."""
    known = parent.select(F.col("sample_id").alias("__id"), F.col("split").alias("__split"))
    joined = child.join(known, child["parent_sample_id"] == F.col("__id"), "left")
    rules = joined.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("__id").isNull()).alias("orphans"),
        F.count_if(~F.col("split").eqNullSafe(F.col("__split"))).alias("split_differs"),
        F.count_if(~F.col("parent_split").eqNullSafe(F.lit(allowed))).alias("wrong_parent_split"),
        F.count_if(~F.col("__split").eqNullSafe(F.lit(allowed))).alias("parent_outside_split"),
        F.countDistinct("parent_sample_id").alias("parents"))
    return rules.withColumn("repeated_parents", F.col("rows") - F.col("parents"))


def expand_conditions(parents: DataFrame, conditions=fixed.ROBUSTNESS_CONDITIONS) -> DataFrame:
    """Every parent once per condition of a fixed list."""
    listed = F.array(*[F.struct(F.lit(n).alias("augmentation_condition"),
                                F.lit(p).alias("augmentation_parameters")) for n, p in conditions])
    return parents.select("*", F.inline(listed))


def _split_flags(split: Column) -> list[Column]:
    return [F.bool_or(split == s) for s in fixed.SPLITS]


def namespace_overlap(df: DataFrame, source_a: str, source_b: str, key: str, attribute: str,
                      source: str = "source_dataset", split: str = "split") -> DataFrame:
    """Ids that two sources share, whether an attribute agrees, and which straddle splits once pooled."""
    in_a, in_b = F.col(source) == source_a, F.col(source) == source_b
    per_id = df.where(F.col(source).isin(source_a, source_b)).groupBy(key).agg(
        F.bool_or(in_a).alias("a"), F.bool_or(in_b).alias("b"),
        F.min(F.when(in_a, F.col(attribute))).alias("attr_a"),
        F.min(F.when(in_b, F.col(attribute))).alias("attr_b"),
        F.countDistinct(split).alias("splits"))
    both = F.col("a") & F.col("b")
    return per_id.agg(
        F.count_if("a").alias("ids_a"), F.count_if("b").alias("ids_b"), F.count_if(both).alias("shared"),
        F.count_if(both & (F.col("attr_a") == F.col("attr_b"))).alias("attribute_agrees"),
        F.count_if(both & (F.col("splits") > 1)).alias("straddling"))


def chance_probability(df: DataFrame, source_a: str, source_b: str, key: str, attribute: str, value,
                       source: str = "source_dataset") -> DataFrame:
    """Probability that all k ids shared with `source_a` have the attribute: (m/N)^k over b's ids."""
    in_a, in_b = F.col(source) == source_a, F.col(source) == source_b
    per_id = df.where(F.col(source).isin(source_a, source_b)).groupBy(key).agg(
        F.bool_or(in_a).alias("a"), F.bool_or(in_b).alias("b"),
        F.bool_or(in_b & (F.col(attribute) == value)).alias("has"))
    counts = per_id.agg(F.count_if("b").alias("n"), F.count_if(F.col("b") & F.col("has")).alias("m"),
                        F.count_if(F.col("a") & F.col("b")).alias("k"))
    return counts.withColumn("log10_probability", F.round(F.col("k") * F.log10(F.col("m") / F.col("n")), 6))


def cross_label_text(df: DataFrame, text_col: str = "transcript", label: str = "label",
                     split: str = "split") -> DataFrame:
    """Normalised texts under both labels, with the number of real/fake pairs in different splits.

    Pairs are counted from per-split counts and never listed; texts are named by
    the digest of their normal form.
    """
    n = {(v, s): F.count_if((F.col(label) == v) & (F.col(split) == s)) for v in ("real", "fake")
         for s in fixed.SPLITS}
    per_text = df.where(F.col(text_col).isNotNull()).groupBy(clean.text_digest(text_col).alias("text_sha256")).agg(
        F.count_if(F.col(label) == "real").alias("real_rows"),
        F.count_if(F.col(label) == "fake").alias("fake_rows"),
        *[c.alias(f"{v}_{s}") for (v, s), c in n.items()])
    same = reduce(lambda a, b: a + b, [F.col(f"real_{s}") * F.col(f"fake_{s}") for s in fixed.SPLITS])
    return per_text.where("real_rows > 0 AND fake_rows > 0").select(
        "text_sha256", "real_rows", "fake_rows",
        (F.col("real_rows") * F.col("fake_rows") - same).alias("cross_split_pairs"))


def external_overlap(dev: DataFrame, external: DataFrame, dev_text: str, external_text: str,
                     split: str = "split") -> DataFrame:
    """Distinct normalised external texts, and how many occur in train/validation and in all of dev."""
    ours = dev.groupBy(clean.text_digest(dev_text).alias("key")).agg(
        F.bool_or(F.col(split).isin("train", "validation")).alias("seen"))
    theirs = external.select(clean.text_digest(external_text).alias("key")).distinct()
    return theirs.join(ours, "key", "left").agg(
        F.count("*").alias("external_texts"), F.count_if("seen").alias("in_train_validation"),
        F.count("seen").alias("in_development"))


def id_collision(a: DataFrame, b: DataFrame, key: str = "sample_id", content: str = "sha256",
                 path: str = "file_path") -> DataFrame:
    """Ids that two manifests share although content or path differs."""
    left = a.select(key, F.col(content).alias("content_a"), F.col(path).alias("path_a"))
    right = b.select(key, F.col(content).alias("content_b"), F.col(path).alias("path_b"))
    joined = left.join(right, key)
    return joined.select(
        key, (~F.col("content_a").eqNullSafe(F.col("content_b"))).alias("content_differs"),
        (~F.col("path_a").eqNullSafe(F.col("path_b"))).alias("path_differs")) \
        .where("content_differs OR path_differs")


def noop_derivatives(child: DataFrame, parent: DataFrame, condition: str = "augmentation_condition",
                     content: str = "sha256") -> DataFrame:
    """Derivations that changed nothing: child content equals parent content."""
    known = parent.select(F.col("sample_id").alias("parent_sample_id"), F.col(content).alias("__parent"))
    same = F.col(content) == F.col("__parent")
    return child.join(known, "parent_sample_id").groupBy(condition).agg(
        F.count("*").alias("n"), F.count_if(same).alias("noops"),
        F.count_if(same & (F.col("label") == "real")).alias("noops_real"),
        F.count_if(same & (F.col("label") == "fake")).alias("noops_fake")) \
        .withColumn("noop_rate", F.round(F.col("noops") / F.col("n"), 6))


def coverage(manifest: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """Files without a row, rows without a file, and repeated references."""
    referenced = manifest.groupBy(path).agg(F.count("*").alias("refs"))
    on_disk = inventory.select(path).distinct().withColumn("present", F.lit(True))
    return referenced.join(on_disk, path, "full_outer").agg(
        F.count_if(F.col("refs").isNotNull()).alias("referenced"),
        F.count_if(F.col("present").isNotNull()).alias("on_disk"),
        F.count_if(F.col("refs").isNotNull() & F.col("present").isNotNull()).alias("matched"),
        F.count_if(F.col("present").isNull()).alias("referenced_but_missing"),
        F.count_if(F.col("refs").isNull()).alias("on_disk_but_unlabelled"),
        F.count_if(F.col("refs") > 1).alias("referenced_twice"))


def content_duplicates(inventory: DataFrame, content: Column, size: str = "length",
                       collection: str = "collection") -> DataFrame:
    """Exact duplicates, hashing only files that share their size with another file.

    One row per duplicated content with its copies and the collections involved.
    """
    shared = inventory.groupBy(size).agg(F.count("*").alias("__n")).where("__n > 1").select(size)
    hashed = inventory.join(shared, size, "left_semi").select(
        content.alias("content_sha256"), F.col(collection))
    counts = hashed.groupBy("content_sha256", collection).agg(F.count("*").alias("n"))
    groups = counts.groupBy("content_sha256").agg(
        F.sum("n").alias("copies"), F.count("*").alias("collections"),
        F.min(collection).alias("first_collection"), F.max(collection).alias("last_collection"))
    return groups.where("copies > 1").withColumn("redundant", F.col("copies") - 1)


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """Groups, files and redundant copies by first and last collection."""
    return groups.groupBy("first_collection", "last_collection").agg(
        F.count("*").alias("duplicate_groups"), F.sum("copies").alias("files"),
        F.sum("redundant").alias("redundant_copies"))


def slice_intervals(segments: DataFrame, frames: DataFrame, bucket_frames: int = 4096,
                    recording: str = "recording") -> DataFrame:
    """Frames of each segment, `[round(start*rate), min(round(end*rate), length))`.

    A segment is listed once per frame bucket it touches, so the range join is an
    equi join on (recording, bucket) and a long recording spreads over tasks.
    """
    spans = segments.withColumns({
        "start_frame": F.bround(F.col("start_time") * F.col("rate")).cast("bigint"),
        "end_frame": F.bround(F.col("end_time") * F.col("rate")).cast("bigint")}) \
        .where("end_frame > start_frame")
    bucketed = spans.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("start_frame") / bucket_frames), F.floor((F.col("end_frame") - 1) / bucket_frames))))
    keyed = frames.withColumn("bucket", F.floor(F.col("frame") / bucket_frames))
    return bucketed.join(keyed, [recording, "bucket"]) \
        .where("frame >= start_frame AND frame < end_frame").drop("bucket")


def slice_report(segments: DataFrame, sliced: DataFrame, key: str = "segment_id") -> DataFrame:
    """Frames cut per segment; 0 marks an empty span."""
    counts = sliced.groupBy(key).agg(F.count("*").alias("n"))
    return segments.select(key).join(counts, key, "left").select(
        key, F.coalesce("n", F.lit(0)).alias("frames"), F.col("n").isNull().alias("empty_span"))


def locate_with_guard(targets: DataFrame, records: DataFrame, block=("file", "block"),
                      position: str = "row_in_group", row_id: str = "row_id") -> DataFrame:
    """Record of each target: by position when the row id agrees, else the first with that row id.

    A position beyond the block, or no match at all, drops the target.
    """
    block = list(block)
    payload = [c for c in records.columns if c not in (*block, position, row_id)]
    narrow = records.select(*block, position, row_id)
    at = narrow.withColumnRenamed(row_id, "__at_id")
    first = narrow.groupBy(*block, row_id).agg(F.min(position).alias("__first"))
    found = targets.join(at, [*block, position]).join(first, [*block, row_id], "left")
    right_place = F.col("__at_id").eqNullSafe(F.col(row_id))
    placed = found.withColumns({"by_position": right_place, "__where": F.when(right_place, F.col(position)).otherwise(F.col("__first"))}) \
        .where("__where IS NOT NULL")
    # the payload is fetched once, for the positions that were chosen
    stored = records.select(*block, F.col(position).alias("__where"), *payload)
    return placed.join(stored, [*block, "__where"]).select(*targets.columns, "by_position", *payload)


def shared_prefixes(a: DataFrame, b: DataFrame, col_a: str, col_b: str, pattern: str) -> DataFrame:
    """Id prefixes (first capture group) found in both sources."""
    def prefixes(df, c):
        return df.where(text(c).rlike(pattern)).select(F.regexp_extract(text(c), pattern, 1).alias("prefix")).distinct()
    return prefixes(a, col_a).join(prefixes(b, col_b), "prefix")


def leaky_groups(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Groups that occur in more than one split."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")


# ---- set operations ----

def union_sources(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_intersection(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    ours = a.select(text(key_a).alias("key"))
    return ours.intersect(b.select(text(key_b).alias("key"))).agg(F.count("*").alias("shared"))


def is_subset(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Whether every key of a occurs in b, with the number of outsiders."""
    outside = a.select(text(key_a).alias("key")).distinct().join(
        b.select(text(key_b).alias("key")), "key", "left_anti")
    return outside.agg(F.count("*").alias("outside")).withColumn("subset", F.col("outside") == 0)


def conditional_purge(df: DataFrame, label: str, sources, label_col: str = "label",
                      source_col: str = "upstream_dataset") -> DataFrame:
    """Drop every row of a label once any of them comes from an excluded source."""
    tainted = df.agg(F.coalesce(F.bool_or((F.col(label_col) == label) & F.col(source_col).isin(list(sources))),
                                F.lit(False)).alias("t")).scalar()
    return df.where(~(F.coalesce(F.col(label_col) == label, F.lit(False)) & tainted))


def replace_partition(df: DataFrame, new: DataFrame, by: str, value) -> DataFrame:
    """Keep all other partitions and take `new` for one."""
    return df.where(~F.col(by).eqNullSafe(F.lit(value))).unionByName(new, allowMissingColumns=True)


def overwrite_partitions(new: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that `new` has rows of, in a table stored by `by`; the files of all others stay as they are."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def check_current(fresh: DataFrame, published: DataFrame) -> DataFrame:
    """Rows missing from and stale in a published table; identical iff both are 0."""
    columns = sorted(fresh.columns)
    marked = fresh.select(*columns).withColumn("__d", F.lit(1)).unionAll(
        published.select(*columns).withColumn("__d", F.lit(-1)))
    balance = marked.groupBy(*columns).agg(F.sum("__d").alias("d"))
    return balance.agg(
        F.coalesce(F.sum(F.greatest(F.col("d"), F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("out_of_date")) \
        .withColumn("current", (F.col("missing") == 0) & (F.col("out_of_date") == 0))
