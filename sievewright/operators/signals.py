"""Signal features of long tables `(recording, frame, value)`, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievewright import fixed_values as fixed
from sievewright.operators.running import exact_quantiles


def _level(value: str) -> Column:
    return F.abs(F.col(value))


def rms_expr(value: str = "value") -> Column:
    return F.sqrt(F.avg(F.col(value) * F.col(value)))


def dbfs(rms: Column, floor: float = fixed.SILENCE_FLOOR_DB) -> Column:
    """Decibels below full scale; digital silence sits at the floor."""
    return F.when(rms > 0, F.greatest(F.lit(floor), 20 * F.log10(rms))).otherwise(F.lit(floor))


def peak(df: DataFrame, by="recording", value="value") -> DataFrame:
    return df.groupBy(by).agg(F.max(_level(value)).alias("peak"))


def clip_fraction(df: DataFrame, full_scale: float, by="recording", value="value") -> DataFrame:
    return df.groupBy(by).agg(F.round(F.count_if(_level(value) >= full_scale) / F.count("*"), 6).alias("clip_fraction"))


def rms_dbfs(df: DataFrame, by="recording", value="value") -> DataFrame:
    return df.groupBy(by).agg(F.round(dbfs(rms_expr(value)), 6).alias("rms_dbfs"))


def edge_silence(df: DataFrame, threshold: float, rate: float, by="recording", frame="frame", value="value") -> DataFrame:
    """Seconds before the first and after the last frame above the threshold.

    A recording that never exceeds it is silent for its whole length on both ends.
    """
    loud = _level(value) > threshold
    found = df.groupBy(by).agg(F.min(F.when(loud, F.col(frame))).alias("first"),
                               F.max(F.when(loud, F.col(frame))).alias("last"),
                               (F.max(frame) + 1).alias("length"))
    return found.select(by,
                        F.round(F.coalesce(F.col("first"), F.col("length")) / rate, 6).alias("leading_s"),
                        F.round((F.col("length") - 1 - F.coalesce(F.col("last"), F.lit(-1))) / rate, 6).alias("trailing_s"))


def voiced_fraction(df: DataFrame, frame_length: int, threshold: float, by="recording", frame="frame",
                    value="value") -> DataFrame:
    """Share of fixed-length frames whose RMS exceeds the threshold."""
    frames = df.groupBy(by, F.floor(F.col(frame) / frame_length).alias("f")).agg(rms_expr(value).alias("r"))
    return frames.groupBy(by).agg(F.count("*").alias("frames"),
                                  F.round(F.count_if(F.col("r") > threshold) / F.count("*"), 6).alias("voiced_fraction"))


def fixed_windows(df: DataFrame, window_frames: int, by="recording", frame="frame", value="value") -> DataFrame:
    """Equal-length windows; an incomplete last window is dropped."""
    return df.groupBy(by, F.floor(F.col(frame) / window_frames).alias("window")).agg(
        F.count("*").alias("frames"), F.max(_level(value)).alias("peak"),
        F.round(rms_expr(value), 6).alias("rms")).where(F.col("frames") == window_frames)


def features(df: DataFrame, threshold: float, full_scale: float, rate: float, by="recording", frame="frame",
             value="value") -> DataFrame:
    """Peak, clipping, level and edge silence in one aggregate."""
    loud = _level(value) > threshold
    found = df.groupBy(by).agg(
        F.max(_level(value)).alias("peak"),
        (F.count_if(_level(value) >= full_scale) / F.count("*")).alias("clip_fraction"),
        dbfs(rms_expr(value)).alias("rms_dbfs"), (F.max(frame) + 1).alias("length"),
        F.min(F.when(loud, F.col(frame))).alias("first"), F.max(F.when(loud, F.col(frame))).alias("last"))
    return found.select(
        by, "peak", "clip_fraction", "rms_dbfs", (F.col("length") / rate).alias("seconds"),
        (F.coalesce(F.col("first"), F.col("length")) / rate).alias("leading_s"),
        ((F.col("length") - 1 - F.coalesce(F.col("last"), F.lit(-1))) / rate).alias("trailing_s"))


def dead_signal(features_df: DataFrame, peak_limit: float, rms_limit_db: float) -> DataFrame:
    """Pure zeros, and recordings near silence by peak or level."""
    zero = F.col("peak") == 0
    near = (F.col("peak") < peak_limit) | (F.col("rms_dbfs") < rms_limit_db)
    return features_df.where(zero | near).withColumn("verdict", F.when(zero, "zeros").otherwise("near silent"))


def acoustic_by_source(features_df: DataFrame, by, columns) -> DataFrame:
    """Exact medians of several features per group; features are unpivoted and ranked together."""
    by = list(by)
    listed = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = features_df.select(*by, F.inline(listed))
    return exact_quantiles(long, [*by, "feature"], "x", {"median": 0.5})
