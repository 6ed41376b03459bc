"""Derived manifests: conditions dealt to parents, parameters, inherited columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievewright import fixed_values as fixed
from sievewright.functions import clean
from sievewright.functions.keys import col
from sievewright.operators.joins import expand_conditions
from sievewright.operators.sampling import shuffled_rank, stratified_take

STRATA = ["source_dataset", "label", "language_type"]
INHERITED = ["language_type", "label", "source_dataset", "split", "group_id", "generator"]
OPTIONAL = ["language", "voice"]


def deal_conditions(df: DataFrame, strata=STRATA, conditions=fixed.TRAIN_CONDITIONS,
                    identifier: str = "sample_id", seed=fixed.SEED) -> DataFrame:
    """Conditions dealt in turn to the shuffled rows of each stratum."""
    dealt = shuffled_rank(df, strata, identifier, seed, "position")
    listed = F.array(*[F.lit(c) for c in conditions])
    at = ((F.col("position") - 1) % len(conditions)).cast("int")
    return dealt.withColumns({"position": F.col("position") - 1,
                              "augmentation_condition": F.element_at(listed, at + 1)})


def cycle_params(condition, position) -> Column:
    """Parameters as JSON with sorted keys; listed values cycle with the position."""
    condition, position = col(condition), col(position)

    def cycled(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (position % len(values)).cast("int") + 1)

    def codec(name):
        return clean.params_json(codec=F.lit(name), bitrate_kbps=F.split_part(condition, F.lit("_"), F.lit(2)).cast("int"))

    return (F.when(F.startswith(condition, F.lit("mp3")), codec("mp3"))
            .when(F.startswith(condition, F.lit("opus")), codec("opus"))
            .when(condition == "telephone", clean.params_json(band_hz=F.lit(fixed.TELEPHONE_BAND),
                                                              intermediate_rate=F.lit(fixed.TELEPHONE_RATE)))
            .when(condition == "lowpass", clean.params_json(cutoff_hz=cycled(fixed.LOWPASS_CUTOFFS)))
            .when(condition == "gain", clean.params_json(gain_db=cycled(fixed.GAIN_DB)))
            .when(condition == "mild_clipping", clean.params_json(boost_db=F.lit(fixed.CLIPPING_BOOST_DB)))
            .when(condition == "multi_codec", clean.params_json(chain=cycled(fixed.MULTI_CODEC_CHAINS)))
            .otherwise(F.lit("{}")))


def derive_manifest(plan: DataFrame, prefix: str, id_col: str, folder: str) -> DataFrame:
    """One row per planned derivation; split, label and group come unchanged from the parent.

    Language and voice are inherited where the parent has them; the path and duration of
    the parent's processed file are kept beside the derived path.
    """
    gender = F.col("gender_normalized") if "gender_normalized" in plan.columns else clean.normalize_category("gender")
    name = F.concat(F.lit(f"{prefix}_"), F.col("sample_id"), F.lit("__"), F.col("augmentation_condition"))
    return plan.select(
        name.alias(id_col), F.col("sample_id").alias("parent_sample_id"),
        F.concat(F.lit(f"{folder}/"), name, F.lit(".wav")).alias("augmented_file_path"),
        *INHERITED, *[c for c in OPTIONAL if c in plan.columns], gender.alias("gender_normalized"), F.col("split").alias("parent_split"),
        F.col("processed_file_path").alias("parent_processed_path"), F.col("processed_duration").alias("parent_duration"),
        "augmentation_condition", "augmentation_parameters",
        "license", "license_status", clean.redistribution_flag("license_status").alias("redistribution_allowed"))


def plan_train(master: DataFrame, seed=fixed.SEED, split: str = "train") -> DataFrame:
    """One dealt condition with parameters for every training parent."""
    dealt = deal_conditions(master.where(F.col("split") == split), seed=seed)
    planned = dealt.withColumn("augmentation_parameters", cycle_params("augmentation_condition", "position"))
    return derive_manifest(planned, "aug", "augmentation_id", "data/augmented")


def plan_robustness(master: DataFrame, per_stratum: int = 100, seed=fixed.SEED + 1, split: str = "test",
                    strict: bool = True) -> DataFrame:
    """The same test parents under every robustness condition; short strata are an error unless not strict."""
    parents = stratified_take(master.where(F.col("split") == split), ["language_type", "label"], per_stratum, seed=seed, strict=strict)
    return derive_manifest(expand_conditions(parents), "rob", "robustness_id", "data/robustness")
