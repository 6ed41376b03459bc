"""Counting audits: distributions, summaries, reconciliation, duplicates, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievewright import fixed_values as fixed
from sievewright.functions import clean
from sievewright.functions.keys import col, text
from sievewright.operators.running import exact_quantiles, first_per_group

BLANK = r"(?U)^\s*$"


def _filled(c) -> Column:
    return F.coalesce(~text(c).rlike(BLANK), F.lit(False))


def _beside(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """Put two tables with one row per group side by side; a NULL key equals itself, no group of `left` is lost."""
    if not by:
        row = right.select(F.struct(*right.columns).alias("r")).scalar()
        return left.withColumn("__r", row).select(*left.columns, "__r.*")
    key = F.struct(*[F.col(b) for b in by])
    return left.withColumn("__k", key).join(right.withColumn("__k", key).drop(*by), "__k", "left").drop("__k")


def value_counts(df: DataFrame, column: str, dropna: bool = True, skip_blank: bool = False) -> DataFrame:
    if skip_blank:
        df = df.where(_filled(column))
    elif dropna:
        df = df.where(F.col(column).isNotNull())
    return df.groupBy(column).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, sets, columns=None) -> DataFrame:
    """Counts for several key sets in one pass (GROUPING SETS); `scope` names the set."""
    columns = columns or sorted({c for s in sets for c in s})
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    top = len(columns) - 1
    name = F.lit(None).cast("string")
    for keys in sets:
        absent = sum(1 << (top - i) for i, c in enumerate(columns) if c not in keys)
        name = F.when(F.col("gid") == absent, F.lit("+".join(keys) or "all")).otherwise(name)
    return grouped.agg(F.count("*").alias("n"), F.grouping_id().alias("gid")) \
        .select(name.alias("scope"), *columns, "n")


def median_by(df: DataFrame, by, value: str, approximate: bool = False) -> DataFrame:
    if approximate:
        return df.groupBy(*by).agg(F.count(value).alias("n"), F.percentile_approx(value, 0.5).alias("median"))
    return exact_quantiles(df, by, value, {"median": 0.5})


def quantile_table(df: DataFrame, by, value: str, probs=None, approximate: bool = False) -> DataFrame:
    probs = probs or {"q_min": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q_max": 1.0}
    if approximate:
        found = df.groupBy(*by).agg(F.count(value).alias("n"),
                                    F.percentile_approx(value, list(probs.values())).alias("q"))
        return found.select(*by, "n", *[F.col("q")[i].alias(p) for i, p in enumerate(probs)])
    return exact_quantiles(df, by, value, probs)


def crosstab(df: DataFrame, rows: str, column: str, values, ratio: str | None = None) -> DataFrame:
    """Contingency table over known column values; optionally the share of one of them."""
    table = df.groupBy(rows).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values],
                                 F.count(column).alias("n"))
    if ratio is None:
        return table
    return table.withColumn(f"share_{ratio}", F.round(F.col(f"n_{ratio}") / F.col("n"), 6))


def _quotient(whole: str, unit: str, plain: Column) -> Column:
    """whole / unit of whole billionths, at six decimals, halves away from zero; `plain` where values had no whole billionths."""
    sized = f"CAST(sign({whole}) AS INT) * ((abs({whole}) * 2 + 1000 * {unit}) div (2000 * {unit}))"
    return F.when(F.col("__odd") == 0, F.expr(sized) / 1e6).otherwise(F.round(plain, 6))


def duration_summary(df: DataFrame, by, value: str = "duration") -> DataFrame:
    """Hours and mean come from exact sums of whole billionths of a second, so neither the order of rows nor a half decides a digit by chance."""
    by, seconds = list(by), F.col(value).cast("double")
    whole = F.abs(seconds) < 1e12       # neither NaN nor beyond all durations
    stats = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.sum(F.when(whole, F.round(seconds * 1e9)).cast("decimal(28,0)")).alias("__sum"), F.count("*").alias("__n"),
        F.count_if(~whole).alias("__odd"), F.sum(value).alias("__total"), F.min(value).alias("min_s"), F.max(value).alias("max_s"))
    stats = stats.select(*by, _quotient("__sum", "3600", F.col("__total") / 3600).alias("hours"), "min_s",
                         _quotient("__sum", "__n", F.col("__total") / F.col("__n")).alias("mean_s"), "max_s")
    medians = exact_quantiles(df, by, value, {"median_s": 0.5})
    return _beside(stats, medians, by)


def threshold_counts(df: DataFrame, value: str, cuts, by=()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(value) < c).alias(f"under_{c:g}".replace(".", "_")) for c in cuts])


def reconcile(df: DataFrame, expected: DataFrame, keys) -> DataFrame:
    """Expected against actual counts; groups outside the expectation are marked unexpected."""
    actual = df.groupBy(*keys).agg(F.count("*").alias("actual"))
    return expected.join(actual, list(keys), "full_outer").select(
        *keys, F.col("expected").isNull().alias("unexpected"),
        F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"),
        F.coalesce("actual", F.lit(0)).alias("actual")) \
        .withColumn("matches", ~F.col("unexpected") & (F.col("expected") == F.col("actual")))


def integrity(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"), F.count_if(~F.col("exists")).alias("missing_files"),
        F.count_if(F.col("file_bytes") == 0).alias("zero_byte"),
        F.count_if(F.col("probe_error").isNotNull()).alias("probe_errors"),
        F.coalesce(F.sum("file_bytes"), F.lit(0)).alias("total_bytes"),
        F.countDistinct("sha256").alias("unique_sha256"))


def duplicate_rows(df: DataFrame, column: str, drop_null: bool = False) -> DataFrame:
    """Both duplicate counts: all members of repeated values, and surplus copies."""
    if drop_null:
        df = df.where(F.col(column).isNotNull())
    repeated = df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
    return repeated.agg(F.count("*").alias("repeated_values"),
                        F.coalesce(F.sum("n"), F.lit(0)).alias("members"),
                        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def declared_vs_actual(df: DataFrame, tolerance: float = fixed.DURATION_TOLERANCE) -> DataFrame:
    """An unparsable declared rate counts as a mismatch, an unparsable duration does not."""
    rate = clean.number("declared_sample_rate")
    both_rates = F.col("declared_sample_rate").isNotNull() & F.col("original_sample_rate").isNotNull()
    gap = F.abs(clean.number("declared_duration") - clean.number("duration"))
    return df.agg(
        F.count_if(both_rates).alias("rates_compared"),
        F.count_if(both_rates & ~rate.eqNullSafe(F.col("original_sample_rate").cast("double"))).alias("rate_mismatch"),
        F.count_if(F.col("declared_duration").isNotNull() & F.col("duration").isNotNull()).alias("durations_compared"),
        F.count_if(gap > tolerance).alias("duration_mismatch"))


def drift(df: DataFrame, before: str, after: str, tolerance: float = fixed.DURATION_TOLERANCE, by=()) -> DataFrame:
    """Absolute change of a value: max, mean, median and rows beyond tolerance; a group without a value has n = 0."""
    by = list(by)
    delta = df.withColumn("__delta", F.abs(clean.number(after) - clean.number(before)))
    stats = delta.groupBy(*by).agg(F.max("__delta").alias("max_delta"), F.avg("__delta").alias("mean_delta"),
                                   F.count_if(F.col("__delta") > tolerance).alias("over_tolerance"))
    medians = exact_quantiles(delta, by, "__delta", {"median_delta": 0.5})
    return _beside(stats, medians, by).select(*by, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "over_tolerance", *[
        F.round(c, 6).alias(c) for c in ("max_delta", "mean_delta", "median_delta")])


def before_after(df: DataFrame, before: str, after: str, by) -> DataFrame:
    """Value counts of two columns side by side."""
    sides = F.array(F.struct(text(before).alias("value"), F.lit(1).alias("b"), F.lit(0).alias("a")),
                    F.struct(text(after).alias("value"), F.lit(0).alias("b"), F.lit(1).alias("a")))
    return df.select(*by, F.inline(sides)).where("value IS NOT NULL").groupBy(*by, "value").agg(
        F.sum("b").alias("before"), F.sum("a").alias("after"))


def entity_counts(df: DataFrame, entity: str = "speaker_id", by=("source_dataset",), approximate=False) -> DataFrame:
    value = F.when(_filled(entity), F.col(entity))
    distinct = F.approx_count_distinct(value) if approximate else F.countDistinct(value)
    return df.groupBy(*by).agg(F.count(value).alias("rows_with_entity"), distinct.alias("unique_entities"))


def concentration(df: DataFrame, entity: str, by) -> DataFrame:
    """Clips per entity: min, median, mean and max."""
    by = list(by)
    sizes = df.groupBy(*by, entity).agg(F.count("*").alias("clips"))
    stats = sizes.groupBy(*by).agg(F.min("clips").alias("min_clips"), F.round(F.avg("clips"), 6).alias("mean_clips"),
                                   F.max("clips").alias("max_clips"), F.count("*").alias("entities"))
    medians = exact_quantiles(sizes, by, "clips", {"median_clips": 0.5}).drop("n")
    return _beside(stats, medians, by)


def diversity_grade(df: DataFrame, entity: str, by, grades=fixed.DIVERSITY_GRADES,
                    below: str = fixed.DIVERSITY_BELOW) -> DataFrame:
    n = F.col("entities")
    grade = F.lit(below)
    for floor, name in sorted(grades):
        grade = F.when(n >= floor, F.lit(name)).otherwise(grade)
    return df.groupBy(*by).agg(F.countDistinct(entity).alias("entities")).withColumn("grade", grade)


def entity_pool(df: DataFrame, file: str, entity: str) -> DataFrame:
    """Entities and rows per file, and for the whole pool (file NULL)."""
    cells = df.groupBy(file, entity).agg(F.count("*").alias("n"))
    per_file = cells.groupBy(file).agg(F.count("*").alias("entities"), F.sum("n").alias("rows"))
    pool = cells.groupBy(entity).agg(F.sum("n").alias("n")).agg(F.count("*").alias("entities"), F.sum("n").alias("rows"))
    return per_file.select(text(file).alias("file"), "entities", "rows").unionByName(
        pool.select(F.lit("(pool)").alias("file"), "entities", F.coalesce("rows", F.lit(0)).alias("rows")))


def entity_histogram(df: DataFrame, entity: str) -> DataFrame:
    """How many entities have each number of clips."""
    return df.groupBy(entity).agg(F.count("*").alias("clips")).groupBy("clips").agg(F.count("*").alias("entities"))


def cap_reachability(df: DataFrame, entity: str, caps, quota: int, by=()) -> DataFrame:
    """Rows reachable under each cap per entity, from the histogram of entity sizes."""
    by = list(by)
    sizes = df.groupBy(*by, entity).agg(F.count("*").alias("clips"))
    histogram = sizes.groupBy(*by, "clips").agg(F.count("*").alias("m"))
    listed = histogram.withColumn("cap", F.explode(F.array(*[F.lit(c).cast("bigint") for c in caps])))
    return listed.groupBy(*by, "cap").agg(F.sum(F.least("clips", "cap") * F.col("m")).alias("reachable")).select(
        *by, "cap", "reachable", F.ceil(F.lit(quota) / F.col("cap")).alias("entities_needed"),
        (F.col("reachable") >= quota).alias("enough"))


def shared_entities(df: DataFrame, by: str, entity: str, values) -> DataFrame:
    """Entities of each value and of all values together."""
    has = [F.bool_or(F.col(by) == v).alias(f"in_{i}") for i, v in enumerate(values)]
    flags = df.groupBy(entity).agg(*has)
    everywhere = F.lit(True)
    for i in range(len(values)):
        everywhere = everywhere & F.col(f"in_{i}")
    return flags.agg(*[F.count_if(f"in_{i}").alias(f"entities_{str(v).lower()}") for i, v in enumerate(values)],
                     F.count_if(everywhere).alias("shared"), F.count("*").alias("entities"))


def identifier_availability(df: DataFrame, columns, label: str = "label", examples: int = 3) -> DataFrame:
    """Filled and distinct values of candidate id columns by label, with the first few as examples."""
    listed = F.array(*[F.struct(F.lit(c).alias("identifier"), clean.blank_to_null(c).alias("value")) for c in columns])
    cells = df.select(F.col(label), F.inline(listed)).groupBy(label, "identifier", "value").agg(F.count("*").alias("n"))
    stats = cells.groupBy(label, "identifier").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
        F.count("value").alias("unique_values"))
    firsts = first_per_group(cells.where("value IS NOT NULL"), [label, "identifier"], ["value"], examples)
    shown = firsts.groupBy(label, "identifier").agg(
        F.array_join(F.array_sort(F.collect_list("value")), "; ").alias("examples"))
    return stats.join(shown, [label, "identifier"], "left").withColumn("examples", F.coalesce("examples", F.lit("")))


def feasibility(df: DataFrame, quotas: DataFrame, by: str = "label") -> DataFrame:
    counts = df.groupBy(by).agg(F.count("*").alias("available"))
    return quotas.join(counts, by, "left").select(
        by, F.col("quota").cast("bigint").alias("needed"), F.coalesce("available", F.lit(0)).alias("available")) \
        .withColumn("feasible", F.col("available") >= F.col("needed"))


def condition_balance(df: DataFrame, dimensions, condition: str = "augmentation_condition") -> DataFrame:
    """Condition counts along several dimensions in one pass; blank values skipped."""
    listed = F.array(*[F.struct(F.lit(d).alias("dimension"), text(d).alias("value")) for d in dimensions])
    return df.select(condition, F.inline(listed)).where(_filled("value")) \
        .groupBy("dimension", "value", condition).agg(F.count("*").alias("n"))


def derived_set_summary(df: DataFrame, parent_split: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"),
                  F.bool_and(F.col("parent_split") == parent_split).alias("all_parents_in_split"),
                  F.countDistinct("parent_sample_id").alias("unique_parents"),
                  F.countDistinct("augmentation_condition").alias("conditions"))


def condition_by_class(df: DataFrame, condition: str = "augmentation_condition") -> DataFrame:
    return df.groupBy(condition, "label").agg(F.count("*").alias("n"))


def license_rollup(df: DataFrame, ranks: DataFrame) -> DataFrame:
    """Clips per source and licence, each with its strictness rank, and whether it is the strictest."""
    counts = df.groupBy("source_dataset", "license", "license_status").agg(F.count("*").alias("clips"))
    ranked = counts.join(ranks, "license", "left").withColumn("strictness", F.coalesce("strictness", F.lit(0)))
    strictest = ranked.agg(F.max("strictness").alias("m")).scalar()
    return ranked.withColumn("strictest", F.col("strictness") == strictest)


def condition_params(df: DataFrame, condition: str = "augmentation_condition",
                     params: str = "augmentation_parameters") -> DataFrame:
    """Distinct parameter strings per condition with their counts."""
    return df.groupBy(condition, params).agg(F.count("*").alias("n"))


def first_values(df: DataFrame, by, columns, order) -> DataFrame:
    """The row of each group that comes first in the order; order must be total."""
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return picked.select(*by, "r.*")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")) \
        .orderBy(F.desc("n"), column).limit(n)


def text_multiplicity(df: DataFrame, by, text_col: str = "transcript", group: str | None = None) -> DataFrame:
    """Clips per unique text, highest reuse; `vacuous` marks a grouping with one row per group."""
    by = list(by)
    cells = df.where(F.col(text_col).isNotNull()).groupBy(*by, clean.text_digest(text_col).alias("key")).agg(
        F.count("*").alias("n"))
    table = cells.groupBy(*by).agg(
        F.sum("n").alias("clips"), F.count("*").alias("unique_texts"), F.max("n").alias("max_reuse"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("clips_sharing_text"))
    if group is None:
        return table.withColumn("vacuous", F.col("clips") == F.col("unique_texts"))
    groups = df.where(F.col(text_col).isNotNull()).groupBy(*by).agg(F.countDistinct(group).alias("groups"))
    return _beside(table, groups, by).withColumn("vacuous", F.col("clips") == F.col("groups"))


def script_profile(df: DataFrame, text_col: str, language_col: str, mixed_language: str,
                   script_a: str, script_b: str, name_a: str, name_b: str) -> DataFrame:
    """Rows per script class, and how often the declared language disagrees about mixing."""
    kind = clean.script_class(text_col, script_a, script_b, name_a, name_b)
    declared = F.col(language_col) == mixed_language
    return df.groupBy(kind.alias("script")).agg(
        F.count("*").alias("n"), F.count_if(declared).alias("declared_mixed"),
        F.count_if(~F.coalesce(declared, F.lit(False))).alias("not_declared_mixed"))


def name_templates(df: DataFrame, path: str) -> DataFrame:
    return df.groupBy(clean.directory_of(path).alias("folder"),
                      clean.name_template(F.regexp_extract(text(path), r"([^/]*)$", 1)).alias("template")) \
        .agg(F.count("*").alias("n"))


def storage_by_dir(df: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """Files and bytes per directory with a grand total (rollup)."""
    return df.select(clean.directory_of(path).alias("directory"), F.col(size).alias("b")).rollup("directory").agg(
        F.count("*").alias("files"), F.sum("b").alias("bytes"), F.grouping("directory").alias("g")) \
        .select(F.when(F.col("g") == 1, F.lit("(total)")).otherwise(F.col("directory")).alias("directory"),
                "files", "bytes", F.round(F.col("bytes") / 1e9, 9).alias("gigabytes"))


def entities_per_split(df: DataFrame, keys, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("clips"),
                                 *[F.countDistinct(k).alias(f"unique_{k}") for k in keys])


def values_per_split(df: DataFrame, column: str, split: str = "split", splits=fixed.SPLITS) -> DataFrame:
    """Rows of each value in each split; `absent_somewhere` fails a balanced design."""
    table = df.groupBy(column).agg(*[F.count_if(F.col(split) == s).alias(s) for s in splits])
    absent = F.lit(False)
    for s in splits:
        absent = absent | (F.col(s) == 0)
    return table.withColumn("absent_somewhere", absent)


def empty_splits(df: DataFrame, by: str = "source_dataset", split: str = "split", splits=fixed.SPLITS,
                 skip_absent: bool = False) -> DataFrame:
    """Sources that a split lacks; `skip_absent` ignores a split nobody has."""
    counts = df.groupBy(by).agg(*[F.count_if(F.col(split) == s).alias(s) for s in splits])
    listed = counts.select(by, F.inline(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("n"))
                                                  for s in splits]))).where("n = 0")
    if skip_absent:
        used = F.array_compact(F.array(*[F.when(F.bool_or(F.col(split) == s), F.lit(s)) for s in splits]))
        listed = listed.withColumn("__used", df.agg(used.alias("u")).scalar()) \
            .where(F.array_contains("__used", F.col("split")))
    return listed.select(by, "split")
