"""The user-level jobs: build, audit, repair, derive, freeze, publish, select.

Reports are tidy tables `(metric, scope, item, value)` with text values, so the
parts of a report can be unioned, filtered and compared. A job that reads its
input many times first writes it once to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from sievewright import fixed_values as fixed
from sievewright.functions import clean
from sievewright.functions.keys import text
from sievewright.operators import conform, counts, gates, joins, sampling, shortcuts, splits
from sievewright.session import settled
from sievewright.sources import files

GROUP = ["language_type", "label", "source_dataset"]


def _joined(columns) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(text(c), F.lit("")) for c in columns]) if columns else F.lit("all")


def _rounded(value: str) -> Column:
    """A double at six decimals as text: plain from 0.0001 to 10^16, where Spark's own cast turns to 1.0E-4 and 1.0E7; 1e-05 below."""
    shown, size = F.round(value, 6), F.abs(F.round(value, 6))
    plain = F.regexp_replace(shown.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    small = F.regexp_replace(F.regexp_replace(text(shown), r"\.0E", "E"), "E-", "e-0")
    return (F.when((size >= 1e-4) & (size < 1e-3) | (size >= 1e7) & (size < 1e16), plain)
            .when((size > 0) & (size < 1e-4), small).otherwise(text(shown)))


def tidy(df: DataFrame, metric: str, scope=(), values=()) -> DataFrame:
    """One report line per scope and value column; doubles with six decimals."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)}
    items = F.array(*[F.struct(F.lit(v).alias("item"), (_rounded(v) if v in doubles else text(v)).alias("value"))
                      for v in values])
    return df.select(F.lit(metric).alias("metric"), _joined(scope).alias("scope"), F.inline(items))


def _report(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _align(df: DataFrame, mapping: dict, origin: str) -> DataFrame:
    speakers = {c: c for c in ("speaker_id", "target_speaker_id", "source_speaker_id")}
    return conform.align_source(conform.unify_entity_id(df), {**mapping, **speakers}, origin)


def build_master(sources: dict, mapping: dict, inventory: DataFrame, licenses: DataFrame) -> DataFrame:
    """Align and union the sources, probe their files, attach licences, fix the column order."""
    frames = [_align(df, mapping, f"metadata/{name}.csv") for name, df in sources.items()]
    master = files.probe(joins.union_sources(frames), inventory, "file_path")
    name, status = fixed.UNKNOWN_LICENSE
    licensed = conform.attach_lookup(master, "source_dataset", licenses, {"license": name, "license_status": status})
    return conform.select_existing(licensed, fixed.MASTER_COLUMNS)


def audit_master(master: DataFrame, expected: DataFrame) -> DataFrame:
    """Integrity, counts, reconciliation, durations, declared values, speakers, leakage, shortcuts, licences."""
    m = settled(master, "master")
    integrity = ["rows", "missing_files", "zero_byte", "probe_errors", "total_bytes", "unique_sha256"]
    leak = [f"{a}_{b}" for a, b in gates.PAIRS]
    return _report(
        tidy(counts.integrity(m), "integrity", (), integrity),
        *[tidy(counts.duplicate_rows(m, c, drop_null=c == "sha256"), "duplicates", (F.lit(c),), ["members", "surplus"])
          for c in ("sample_id", "file_path", "sha256")],
        tidy(counts.distribution(m, [GROUP, ["split"], ["label", "split"]]), "distribution",
             ("scope", *sorted({*GROUP, "split"})), ["n"]),
        tidy(counts.reconcile(m, expected, GROUP), "reconcile", GROUP, ["expected", "actual", "matches"]),
        tidy(counts.duration_summary(m, GROUP).withColumn("median_s", F.round("median_s", 9)), "duration", GROUP, ["n", "hours", "min_s", "median_s", "mean_s", "max_s"]),
        tidy(counts.threshold_counts(m, "duration", [2, 1]), "short", (), ["under_2", "under_1"]),
        tidy(counts.declared_vs_actual(m), "declared", (), ["rate_mismatch", "duration_mismatch"]),
        tidy(counts.entity_counts(m), "speakers", ["source_dataset"], ["rows_with_entity", "unique_entities"]),
        tidy(gates.split_leakage(m, "speaker_id", drop_missing=True), "leakage", ["scope"], leak),
        tidy(shortcuts.perfect_separator(m, ["codec", "original_sample_rate", "channels"]), "separator",
             ["scope", "feature"], ["shared_values", "ambiguous_rows", "perfect"]),
        tidy(counts.empty_splits(m, skip_absent=True), "empty split", ["source_dataset", "split"], ["split"]),
        *[tidy(counts.value_counts(m, c), "values", (F.lit(c), c), ["n"]) for c in ("codec", "channels")],
        tidy(counts.crosstab(m, "source_dataset", "split", fixed.SPLITS), "split by source", ["source_dataset"], [f"n_{s}" for s in fixed.SPLITS]),
        tidy(m.groupBy("license_status").agg(F.count("*").alias("clips")), "licence", ["license_status"], ["clips"]),
        tidy(m.groupBy("source_dataset", "license", "license_status").agg(F.count("*").alias("clips")), "licence by source",
             ["source_dataset", "license", "license_status"], ["clips"]))


def repair_splits(df: DataFrame, source: str, key_by_source: dict, default_key: str, targets: dict | None = None,
                  entity: str = "speaker_id") -> DataFrame:
    """Composite group ids, canonical gender, and one source re-split greedily by entity."""
    named = df.withColumns({
        "group_id": clean.composite_group_id("source_dataset", key_by_source, default_key),
        "gender_normalized": clean.normalize_category("gender")})
    chosen = F.col("source_dataset") == source
    assignment = splits.greedy_assignment(named.where(chosen), entity, targets).select(entity, "new_split")
    return joins.apply_assignment(named, assignment, entity, chosen)


def repair_report(repaired: DataFrame) -> DataFrame:
    table = counts.crosstab(repaired, "source_dataset", "split", fixed.SPLITS)
    leak = [f"{a}_{b}" for a, b in gates.PAIRS]
    return _report(tidy(table, "rows", ["source_dataset"], [f"n_{s}" for s in fixed.SPLITS]),
                   tidy(gates.split_leakage(repaired, "group_id"), "leakage", ["scope"], leak))


def audit_canonical(master: DataFrame, results: DataFrame) -> DataFrame:
    """Rows with and without a processed file, then integrity, formats, before/after and duration drift of the processed ones."""
    every = settled(joins.merge_results(master, results, "sample_id"), "canonical")
    m = every.where("processed_file_path IS NOT NULL")
    integrity = ["rows", "missing_files", "zero_byte", "probe_errors"]
    uniform = {"processed_sample_rate": ["16000"], "processed_channels": ["1"], "processed_codec": ["WAV/PCM_16"]}
    changes = ["n", "over_tolerance", "max_delta", "mean_delta", "median_delta"]
    return _report(
        tidy(every.groupBy("source_dataset").agg(F.count("*").alias("rows"), F.count("processed_file_path").alias("processed"))
             .withColumn("unprocessed", F.col("rows") - F.col("processed")), "processing", ["source_dataset"], ["rows", "processed", "unprocessed"]),
        tidy(counts.integrity(m), "integrity", (), integrity),
        tidy(gates.value_set_equals(m, uniform), "uniform", ["column_name"], ["distinct_values", "uniform"]),
        tidy(counts.before_after(m, "codec", "processed_codec", ["source_dataset"]), "codec",
             ["source_dataset", "value"], ["before", "after"]),
        tidy(counts.before_after(m, "original_sample_rate", "processed_sample_rate", ["source_dataset"]), "sample rate",
             ["source_dataset", "value"], ["before", "after"]),
        tidy(counts.drift(m, "duration", "processed_duration"), "drift", (), changes),
        tidy(counts.drift(m, "duration", "processed_duration", by=["source_dataset"]), "drift by source",
             ["source_dataset"], changes),
        tidy(counts.duration_summary(m, ["split"], "processed_duration"), "duration", ["split"], ["n", "hours", "median_s"]),
        tidy(counts.duplicate_rows(m, "processed_sha256"), "duplicates", (), ["members", "surplus"]))


def audit_shortcuts(master: DataFrame, augmented: DataFrame, robustness: DataFrame) -> DataFrame:
    """Shortcut tables before and after canonicalisation, and the balance of dealt conditions."""
    augmented, robustness = settled(augmented, "augmented"), settled(robustness, "robustness")
    featured = master.withColumns({"duration_bin": clean.bin_numeric("duration"),
                                   "bit_depth": clean.bit_depth("codec"),
                                   "processed_bit_depth": clean.bit_depth("processed_codec")})
    original = ["source_dataset", "codec", "original_sample_rate", "bit_depth", "duration_bin", "gender_normalized",
                "generator", "voice"]
    canonical = ["processed_codec", "processed_sample_rate", "processed_bit_depth", "processed_channels"]
    named = {f"original {c}": c for c in original} | {f"canonical {c}": c for c in canonical}
    values = ["n", "distinct_values", "majority_accuracy", "cramers_v", "shared_values", "verdict"]
    aug = shortcuts.shortcut_audit(augmented, {"augmentation_condition": "augmentation_condition"},
                                   scopes="language_type")
    dims = ["source_dataset", "label", "generator", "voice", "gender_normalized"]
    return _report(
        tidy(shortcuts.shortcut_audit(featured, named, scopes="language_type"), "master", ["scope", "feature"], values),
        tidy(aug, "augmented", ["scope", "feature"], values),
        tidy(counts.condition_balance(augmented, dims), "balance",
             ["dimension", "value", "augmentation_condition"], ["n"]),
        tidy(counts.derived_set_summary(robustness, "test"), "robustness", (),
             ["total", "all_parents_in_split", "unique_parents"]),
        tidy(counts.condition_by_class(robustness), "robustness by class", ["augmentation_condition", "label"], ["n"]))


def freeze(master: DataFrame, augmented: DataFrame, robustness: DataFrame, sizes: dict, inventory: DataFrame) -> DataFrame:
    """Every rule of the freeze with its observation, the facts to record, and one verdict.

    One aggregate per manifest, plus leakage, inheritance and overlap checks; the
    files of all three collections are compared with the inventory. Facts (fingerprints, parameters, terms,
    storage) expect nothing and have no `ok`; frozen is true iff all rules hold.
    """
    files_seen = settled(inventory, "inventory")
    m, a, r = settled(master, "master"), settled(augmented, "augmented"), settled(robustness, "robustness")
    leak = gates.split_leakage(m, "group_id").agg(
        *[F.sum(f"{x}_{y}").alias(f"{x}_{y}") for x, y in gates.PAIRS])
    parts = [
        (gates.rule_gate(m, {
            "master rows": (F.count("*"), sizes["master"]),
            "uniform rate": (gates.equals_set("processed_sample_rate", ["16000"]), True),
            "uniform channels": (gates.equals_set("processed_channels", ["1"]), True),
            "uniform codec": (gates.equals_set("processed_codec", ["WAV/PCM_16"]), True),
            "repeated sample_id": (gates.surplus("sample_id"), 0),
            "repeated path": (gates.surplus("processed_file_path"), 0)}), "master"),
        (gates.rule_gate(a, {
            "augmented rows": (F.count("*"), sizes["augmented"]),
            "repeated id": (gates.surplus("augmentation_id"), 0),
            "repeated path": (gates.surplus("augmented_file_path"), 0)}), "augmented"),
        (gates.rule_gate(r, {
            "robustness rows": (F.count("*"), sizes["robustness"]),
            "repeated id": (gates.surplus("robustness_id"), 0),
            "repeated path": (gates.surplus("augmented_file_path"), 0)}), "robustness"),
        (gates.rule_gate(leak, {f"{x}/{y}": (F.sum(f"{x}_{y}"), 0) for x, y in gates.PAIRS}), "group leakage"),
    ]
    for child, allowed, name in ((a, "train", "augmented"), (r, "test", "robustness")):
        found = joins.check_inheritance(child, m, allowed)
        rules = ["orphans", "split_differs", "wrong_parent_split", "parent_outside_split"]
        if name == "augmented":
            rules.append("repeated_parents")
        parts.append((gates.rule_gate(found, {c: (F.sum(c), 0) for c in rules}), f"{name} inheritance"))
    shared = joins.key_intersection(a, r, "parent_sample_id", "parent_sample_id")
    parts.append((gates.rule_gate(shared, {"parents in both sets": (F.sum("shared"), 0)}), "overlap"))
    facts = [_fact("parameters", counts.condition_params(a), ["augmentation_condition", "augmentation_parameters"], "n"),
             _fact("terms", m.groupBy("source_dataset", "license", "license_status").agg(F.count("*").alias("n")),
                   ["source_dataset", "license", "license_status"], "n"),
             _fact("storage", counts.storage_by_dir(files_seen), ["directory"], "bytes")]
    for df, name, identifier, path, content in ((m, "master", "sample_id", "processed_file_path", "processed_sha256"),
                                                (a, "augmented", "augmentation_id", "augmented_file_path", "sha256"),
                                                (r, "robustness", "robustness_id", "augmented_file_path", "sha256")):
        checked = gates.verify_hashes(df.select(identifier, path, F.col(content).alias("sha256")), files_seen, identifier, path)
        parts.append((gates.rule_gate(gates.verification_summary(checked), {
            c: (F.sum(c), 0) for c in ("missing", "zero_byte", "hash_mismatches")}), f"{name} content"))
        facts.append(_fact(f"{name} content", gates.fingerprint(df, identifier, content), [F.lit("fingerprint")], "fingerprint"))
    columns = ["part", "rule", "observed", "expected", "ok"]
    rules = settled(_report(*[p.withColumn("part", F.lit(n)).select(columns) for p, n in parts]), "rules")
    verdict = rules.agg(F.bool_and("ok").alias("ok")).select(
        F.lit("verdict").alias("part"), F.lit("frozen").alias("rule"), F.col("ok").cast("string").alias("observed"), F.lit("true").alias("expected"), "ok")
    return _report(rules, verdict, *facts).select(columns)


def _fact(part: str, df: DataFrame, scope, value: str) -> DataFrame:
    return df.select(F.lit(part).alias("part"), _joined(scope).alias("rule"), text(value).alias("observed"),
                     F.lit(None).cast("string").alias("expected"), F.lit(None).cast("boolean").alias("ok"))


def publish(master: DataFrame, augmented: DataFrame, robustness: DataFrame, salt: str, external: DataFrame | None = None,
            external_language: str = "Mixed", inventory: DataFrame | None = None) -> dict[str, DataFrame]:
    """The redacted manifests, each refused if anything forbidden survived.

    The held-out set is `external`; its hashes come from `inventory`.
    """
    made = {"development": conform.redact_master(master, salt),
            "augmented": conform.redact_derived(augmented, "augmentation_id", salt),
            "robustness": conform.redact_derived(robustness, "robustness_id", salt)}
    if external is not None:
        made["external"] = conform.redact_external(external, salt, external_language, inventory)
    return {name: conform.assert_publishable(settled(df, name)) for name, df in made.items()}


def check_published(made: dict[str, DataFrame], published: dict[str, DataFrame]) -> DataFrame:
    """`(manifest, missing, out_of_date, current)`: is what was published what a fresh build gives?"""
    return _report(*[joins.check_current(made[name], df).select(F.lit(name).alias("manifest"), "*") for name, df in published.items()])


def select_speech(segments: DataFrame, texts: DataFrame, speakers: DataFrame, wavs: DataFrame, n: int,
                  lo: float = 1.0, hi: float = 30.0, seed=fixed.SEED, strict: bool = True) -> DataFrame:
    """Assemble, filter, sample evenly over speakers, and split by speaker."""
    usable = conform.usable_filter(joins.assemble_segments(segments, texts, speakers, wavs),
                                   ["speaker_id", "transcript", "wav_name"], "duration", lo, hi)
    picked = settled(sampling.round_robin_sample(usable, "speaker_id", n, "utt_id", seed, strict), "picked")
    return splits.greedy_split(picked, "speaker_id")


def speech_report(picked: DataFrame, frames: DataFrame, rate: int) -> DataFrame:
    """What slicing the selected segments out of their recordings gives, and whether a speaker or recording straddles splits."""
    spans = picked.select(F.col("utt_id").alias("segment_id"), F.col("recording_id").alias("recording"), "start_time", "end_time",
                         F.lit(rate).alias("rate"))
    sliced = joins.slice_report(spans, joins.slice_intervals(spans, frames)).agg(
        F.count("*").alias("segments"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"), F.count_if("empty_span").alias("empty"))
    leak = [f"{a}_{b}" for a, b in gates.PAIRS]
    return _report(tidy(sliced, "slices", (), ["segments", "frames", "empty"]),
                   tidy(gates.multi_key_leakage(picked, ["speaker_id", "recording_id"]), "leakage", ["key"], leak))


def external_report(picked: DataFrame, per_label: int) -> DataFrame:
    """Rows of each label against its quota, and the rules an evaluation set has to keep."""
    rules = gates.rule_gate(picked, {"rows": (F.count("*"), 2 * per_label), "repeated id": (gates.surplus("sample_id"), 0),
                                     "labels": (gates.equals_set("project_label", ["real", "fake"]), True)})
    return _report(tidy(conform.availability(picked, per_label, ["project_label"]), "quota", ["project_label"], ["available", "quota", "enough"]),
                   tidy(rules, "rule", ["rule"], ["observed", "expected", "ok", "frozen"]))


def select_external_eval(index: DataFrame, per_label: int, excluded, groups, spread: str, order, strict: bool = True) -> DataFrame:
    """Both labels sampled evenly over attack groups and voices; excluded sources left out of the real half."""
    labelled = index.withColumn("project_label", clean.map_label("label"))
    kept = settled(conform.exclude_upstream(labelled, "real", excluded, "project_label", "source_dataset"), "index")
    halves = [sampling.nested_round_robin(kept.where(F.col("project_label") == label), groups[label], spread,
                                          per_label, order, strict) for label in ("real", "fake")]
    return reduce(lambda a, b: a.unionByName(b), halves)


def independent_audit(df: DataFrame, inventory: DataFrame, signal: DataFrame, referenced: DataFrame | None = None,
                      on_disk: DataFrame | None = None) -> DataFrame:
    """Coverage, duplicates, text reuse, cross-label texts and acoustic shortcuts, measured from content.

    `referenced` and `on_disk` are the path lists of coverage if these are not those of `df` and `inventory`;
    all other parts read `df` and `inventory` whole. Texts are digested once and the digests settled in their
    place, so no text is written, sorted or sent again.
    """
    m = settled(df.select("path", "source_dataset", "label", "split", clean.text_digest("transcript").alias("transcript")), "manifest")
    inventory = settled(inventory.select("path", "length", "sha256", "collection"), "inventory")
    groups = joins.content_duplicates(inventory, F.col("sha256"))
    cross = joins.cross_label_text(m).agg(F.count("*").alias("texts"), F.coalesce(F.sum("cross_split_pairs"), F.lit(0)).alias("pairs"))
    best = [tidy(shortcuts.best_threshold(signal, c), "threshold", (F.lit(c),), ["n", "best_accuracy", "auc"])
            for c in ("peak", "rms_dbfs", "leading_s", "trailing_s")]
    return _report(
        tidy(joins.coverage(m if referenced is None else referenced, inventory if on_disk is None else on_disk), "coverage", (),
             ["referenced", "on_disk", "matched", "referenced_but_missing", "on_disk_but_unlabelled", "referenced_twice"]),
        tidy(groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("redundant"), F.lit(0)).alias("redundant")),
             "duplicates", (), ["groups", "redundant"]),
        tidy(counts.text_multiplicity(m, ["source_dataset"]), "text reuse", ["source_dataset"],
             ["clips", "unique_texts", "max_reuse", "vacuous"]),
        tidy(cross, "cross-label texts", (), ["texts", "pairs"]), *best)
