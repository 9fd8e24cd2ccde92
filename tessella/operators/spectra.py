"""Spectral operators over magnitude spectra in rows (recording_id, frame_idx, bin, mag)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
FRAME = [KEY, "frame_idx"]


def bin_hz(bins: int, rate: float):
    """Frequency of a bin on an even scale from 0 to half the rate."""
    return F.col("bin") * (rate / 2 / (bins - 1))


def moments(spectrum: DataFrame, bins: int, rate: float) -> DataFrame:
    """Centroid, spread, skewness and kurtosis of each frame, with magnitudes as weights."""
    hz = bin_hz(bins, rate)
    power = [F.sum(F.col("mag") * F.pow(hz, F.lit(float(k)))).alias(f"m{k}") for k in range(5)]  # raw moments: one pass, one shuffle
    got = spectrum.groupBy(*FRAME).agg(*power).where("m0 > 0")
    e = [F.col(f"m{k}") / F.col("m0") for k in range(5)]
    c = e[1]
    var = F.greatest(e[2] - c * c, F.lit(0.0))
    third = e[3] - 3 * c * e[2] + 2 * c * c * c
    fourth = e[4] - 4 * c * e[3] + 6 * c * c * e[2] - 3 * c * c * c * c
    spread = F.sqrt(var)
    return got.select(*FRAME, c.alias("centroid"), spread.alias("spread"), F.when(var > 0, third / F.pow(spread, F.lit(3.0))).otherwise(0.0).alias("skewness"), F.when(var > 0, fourth / (var * var)).otherwise(0.0).alias("kurtosis"))


def moment_stats(spectrum: DataFrame, bins: int, rate: float) -> DataFrame:
    """Means over frames, and the deviation of the centroid, of each recording."""
    got = moments(spectrum, bins, rate).groupBy(KEY)
    return got.agg(F.avg("centroid").alias("centroid_mean"), F.stddev_pop("centroid").alias("centroid_std"), F.avg("spread").alias("spread_mean"), F.avg("skewness").alias("skewness_mean"), F.avg("kurtosis").alias("kurtosis_mean"))


def flatness_crest(spectrum: DataFrame) -> DataFrame:
    """Geometric over arithmetic mean, and largest over root mean square, of each frame; means over frames."""
    m = F.col("mag")
    got = spectrum.groupBy(*FRAME).agg(F.avg(F.log(m + 1e-10)).alias("l"), F.avg(m).alias("a"), F.max(m).alias("x"), F.sqrt(F.avg(m * m)).alias("r"))
    frame = got.select(KEY, (F.exp("l") / (F.col("a") + 1e-10)).alias("f"), (F.col("x") / (F.col("r") + 1e-10)).alias("c"))
    return frame.groupBy(KEY).agg(F.avg("f").alias("flatness_mean"), F.avg("c").alias("crest_mean"))


def high_share(spectrum: DataFrame, bins: int, rate: float, above: float) -> DataFrame:
    """Share of the power at or above a frequency."""
    p = F.col("mag") * F.col("mag")
    total = F.sum(p)
    return spectrum.groupBy(KEY).agg(F.when(total > 0, F.sum(F.when(bin_hz(bins, rate) >= above, p).otherwise(0.0)) / total).otherwise(0.0).alias("hf_energy_ratio"))


def flux(spectrum: DataFrame) -> DataFrame:
    """Root mean square rise of magnitudes from frame to frame; mean and deviation over frames."""
    order = Window.partitionBy(KEY, "bin").orderBy("frame_idx")
    rise = F.greatest(F.lit(0.0), F.col("mag") - F.lag("mag").over(order))
    rows = spectrum.select(*FRAME, rise.alias("rise"), F.lag("mag").over(order).alias("b")).where("b IS NOT NULL")
    frame = rows.groupBy(*FRAME).agg(F.sqrt(F.avg(F.col("rise") * F.col("rise"))).alias("flux"))
    return frame.groupBy(KEY).agg(F.avg("flux").alias("flux_mean"), F.stddev_pop("flux").alias("flux_std"))


def rolloff(spectrum: DataFrame, bins: int, rate: float, share: float = 0.85) -> DataFrame:
    """Mean over frames of the first frequency below which `share` of the power lies."""
    order = Window.partitionBy(*FRAME).orderBy("bin")
    p = F.col("mag") * F.col("mag")
    rows = spectrum.select(*FRAME, "bin", F.sum(p).over(order).alias("c"), F.sum(p).over(Window.partitionBy(*FRAME)).alias("t"))
    first = rows.where(F.col("c") >= share * F.col("t")).groupBy(*FRAME).agg(F.min("bin").alias("bin"))
    return first.groupBy(KEY).agg(F.avg(bin_hz(bins, rate)).alias("rolloff_mean"))


def mean_levels(spectrum: DataFrame) -> DataFrame:
    """(recording_id, bin, mag, db): mean spectrum of each recording, in dB under its largest bin."""
    mean = spectrum.groupBy(KEY, "bin").agg(F.avg("mag").alias("mag"))
    top = F.max("mag").over(Window.partitionBy(KEY))
    return mean.withColumn("db", 20 * F.log10(F.greatest(F.col("mag"), F.lit(1e-10)) / F.greatest(top, F.lit(1e-10))))


def cutoff(spectrum: DataFrame, bins: int, rate: float, from_hz: float, under: float, rest_under: float, drop: float, rest_mean: float, back: int = 12, tail: int = 7) -> DataFrame:
    """First bin where the level falls off for good: low itself, nothing louder after it, a steep drop before it."""
    order = Window.partitionBy(KEY).orderBy("bin")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    rows = mean_levels(spectrum).select(
        KEY, "bin", "db", F.max("db").over(rest).alias("rest_max"), F.avg("db").over(rest).alias("rest_avg"),
        (F.col("db") - F.coalesce(F.lag("db", back).over(order), F.first("db").over(order))).alias("fall"),
    )
    hit = (bin_hz(bins, rate) >= from_hz) & (F.col("bin") < bins - tail) & (F.col("db") < under) & (F.col("rest_max") < rest_under) & (F.col("fall") < drop) & (F.col("rest_avg") < rest_mean)
    got = rows.groupBy(KEY).agg(F.min(F.when(hit, F.col("bin"))).alias("bin"))
    return got.select(KEY, F.col("bin").isNotNull().alias("has_cutoff"), F.coalesce(bin_hz(bins, rate), F.lit(0.0)).alias("cutoff_hz"))


def harmonic_smearing(spectrum: DataFrame) -> DataFrame:
    """1 - (mean local peak over mean local valley) / 15 of the mean spectrum, clipped; 0 with fewer than three of either."""
    order = Window.partitionBy(KEY).orderBy("bin")
    a, b, m = F.lag("mag").over(order), F.lead("mag").over(order), F.col("mag")
    rows = mean_levels(spectrum).select(KEY, "mag", ((m > a) & (m > b)).alias("up"), ((m < a) & (m < b)).alias("down"))
    got = rows.groupBy(KEY).agg(F.count_if("up").alias("p"), F.count_if("down").alias("v"), F.avg(F.when(F.col("up"), m)).alias("pm"), F.avg(F.when(F.col("down"), m)).alias("vm"))
    ratio = F.col("pm") / (F.col("vm") + 1e-10)
    return got.select(KEY, F.when((F.col("p") >= 3) & (F.col("v") >= 3), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio / 15))).otherwise(0.0).alias("smearing"))


def mel_filters(spark, bins: int, rate: float, mels: int, low: float = 0.0) -> DataFrame:
    """(mel, bin, weight): triangular filters; a table of fixed size."""
    to_mel = lambda f: 2595 * math.log10(1 + f / 700)
    to_hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    lo, hi = to_mel(low), to_mel(rate / 2)
    edges = [to_hz(lo + (hi - lo) * k / (mels + 1)) for k in range(mels + 2)]
    rows = []
    for m in range(mels):
        a, c, b = edges[m : m + 3]
        for k in range(bins):
            f = k * rate / 2 / (bins - 1)
            w = max(0.0, min((f - a) / (c - a), (b - f) / (b - c)))
            if w > 0:
                rows.append((m, k, w))
    return spark.createDataFrame(rows, "mel int, bin int, weight double")


def mel_energies(spectrum: DataFrame, bins: int, rate: float, mels: int) -> DataFrame:
    """(recording_id, frame_idx, mel, log_energy): the filter table is of fixed size, so it is broadcast."""
    filters = mel_filters(spectrum.sparkSession, bins, rate, mels)
    got = spectrum.join(F.broadcast(filters), "bin").groupBy(*FRAME, "mel").agg(F.sum(F.col("weight") * F.col("mag")).alias("e"))
    return got.select(*FRAME, "mel", F.log(F.greatest("e", F.lit(1e-6))).alias("log_energy"))


def stat_pooling(mels: DataFrame) -> DataFrame:
    """Mean, deviation and quartiles of each mel band over time."""
    return mels.groupBy(KEY, "mel").agg(F.avg("log_energy").alias("mean"), F.stddev_pop("log_energy").alias("std"), F.percentile("log_energy", 0.25).alias("p25"), F.percentile("log_energy", 0.75).alias("p75"))


def dft_power(frames: DataFrame, size: int) -> DataFrame:
    """(recording_id, frame_idx, k, power) of whole frames in rows (pos, x): a frame's samples meet once and are transformed in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, size)
            power = np.abs(np.fft.rfft(x, axis=1)) ** 2
            n = power.shape[1]
            ids = [pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in FRAME]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.tile(np.arange(n, dtype=np.int32), len(x))), pa.array(power.ravel())], [*FRAME, "k", "power"])

    whole = frames.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s")).where(F.size("s") == size)
    return whole.select(*[F.col(c).cast("long").alias(c) for c in FRAME], F.col("s.x").alias("x")).mapInArrow(run, "recording_id long, frame_idx long, k int, power double")


def band_ratio(power: DataFrame, low: int, high: int) -> DataFrame:
    """Share of power in the bins low to high, over all frames of a recording."""
    total = F.sum("power")
    return power.groupBy(KEY).agg(F.when(total > 0, F.sum(F.when(F.col("k").between(low, high), F.col("power")).otherwise(0.0)) / total).otherwise(0.0).alias("band_ratio"))


def histogram_entropy(values: DataFrame, value: str, low: float, high: float, bins: int = 30) -> DataFrame:
    """Entropy in bits of an even histogram, as a share of its largest value."""
    cell = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    counts = values.where(F.col(value).between(low, high)).groupBy(KEY, cell.alias("cell")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(KEY))
    return counts.select(KEY, (-p * F.log2(p)).alias("h")).groupBy(KEY).agg((F.sum("h") / math.log2(bins)).alias("entropy"))


def energy_entropy(levels: DataFrame, frames: int = 50) -> DataFrame:
    """Entropy in bits of the energy's shares over the first frames."""
    e = F.col("rms") * F.col("rms")
    rows = levels.where(F.col("frame_idx") < frames)
    p = e / F.sum(e).over(Window.partitionBy(KEY))
    return rows.select(KEY, (-p * F.log2(p + 1e-12)).alias("h")).groupBy(KEY).agg(F.sum("h").alias("energy_entropy"))
