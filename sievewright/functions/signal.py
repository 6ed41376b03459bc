"""Waveforms held as arrays: level changes and windows with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sievewright import fixed_values as fixed
from sievewright.functions.keys import col


def _saturate(x: Column) -> Column:
    return F.greatest(F.lit(float(fixed.PCM16_LOW)), F.least(F.lit(float(fixed.PCM16_HIGH)), x))


def _factor(db) -> Column:
    return F.pow(F.lit(10.0), (F.lit(float(db)) if not isinstance(db, Column) else db) / 20)


def to_pcm16(wave) -> Column:
    """Floats in [-1, 1] as 16-bit steps."""
    return F.transform(col(wave), lambda x: _saturate(F.bround(x.cast("double") * 32768)))


def apply_gain(pcm, db) -> Column:
    """Amplify by dB, saturating at the 16-bit range."""
    factor = _factor(db)
    return F.transform(col(pcm), lambda x: F.bround(_saturate(x * factor)))


def mild_clipping(pcm, boost_db: float = fixed.CLIPPING_BOOST_DB) -> Column:
    """Boost into saturation on 16-bit steps, then back by the same amount; quiet input returns unchanged."""
    return apply_gain(apply_gain(pcm, boost_db), -boost_db)


def peak_of(wave) -> Column:
    return F.array_max(F.transform(col(wave), lambda x: F.abs(x.cast("double"))))


def peak_normalize(wave) -> Column:
    """Divide by the peak; silence stays silence."""
    top = peak_of(wave)
    return F.when(top > 0, F.transform(col(wave), lambda x: x.cast("double") / top)) \
        .otherwise(F.transform(col(wave), lambda x: x.cast("double")))


def fixed_windows(wave, length: int) -> Column:
    """Consecutive slices of equal length; an incomplete tail is dropped."""
    wave = col(wave)
    count = F.floor(F.size(wave) / length).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(wave, i * length + 1, F.lit(length)))
