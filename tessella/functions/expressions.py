"""Scalar expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def decibels(x: Column, floor: float = 1e-7) -> Column:
    """20 log10 x; -100 at or below the floor."""
    return F.when(x <= floor, F.lit(-100.0)).otherwise(20 * F.log10(F.greatest(x, F.lit(floor))))


def finite(x: Column) -> Column:
    """The value, or 0 for null, NaN and the infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-clip(z, -20.0, 20.0)))


def bit_depth(subtype: Column) -> Column:
    """Bits of a sample from the name of its encoding; null if unknown."""
    name = F.upper(subtype)
    out = F.when(name.contains("DOUBLE"), 64).when(name.contains("FLOAT"), 32)
    for bits in (16, 24, 32, 8):
        out = out.when(name.contains(str(bits)), bits)
    return out


def hnr_db(peak: Column) -> Column:
    """Harmonics-to-noise ratio from a normalised autocorrelation peak."""
    return F.when(peak >= 0.999, F.lit(30.0)).when(peak <= 0.01, F.lit(0.0)).otherwise(10 * F.log10(peak / (1 - peak)))


def vocal_tract_cm(f1: Column, f3: Column, f4: Column) -> tuple[Column, Column]:
    """(formant dispersion, tract length): spacing from the highest formant found, 1000 Hz without any."""
    spacing = F.when(f4 > 0, (f4 - f1) / 3).when(f3 > 0, (f3 - f1) / 2).otherwise(F.lit(1000.0))
    return spacing, clip(35000 / (2 * spacing), 10.0, 25.0)
