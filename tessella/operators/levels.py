"""Sample-level operators: clean-up, loudness and level statistics of recordings (recording_id, idx, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clip, decibels, finite

KEY = "recording_id"


def sanitize(samples: DataFrame) -> DataFrame:
    """Null, NaN and infinite samples become 0."""
    return samples.withColumn("x", finite(F.col("x")))


def mono_downmix(frames: DataFrame, channels: str = "channels") -> DataFrame:
    """The mean of each sample's channels (an array column)."""
    total = F.aggregate(channels, F.lit(0.0), lambda a, v: a + v)
    return frames.withColumn("x", F.when(F.size(channels) > 0, total / F.size(channels)).otherwise(F.lit(0.0)))


def remove_dc(samples: DataFrame) -> DataFrame:
    """Subtract each recording's mean; the means are one row a recording and are joined back."""
    mean = samples.groupBy(KEY).agg(F.avg("x").alias("mean"))
    return samples.join(mean, KEY).withColumn("x", F.col("x") - F.col("mean")).drop("mean")


def pre_emphasis(samples: DataFrame, coefficient: float = 0.97) -> DataFrame:
    """y = x - coefficient * previous x; the first sample is unchanged."""
    order = Window.partitionBy(KEY).orderBy("idx")
    return samples.withColumn("y", F.col("x") - coefficient * F.coalesce(F.lag("x").over(order), F.lit(0.0)))


def loudness_gain(samples: DataFrame, target_db: float = -20.0) -> DataFrame:
    """(recording_id, rms, peak, gain): what `normalize_loudness` multiplies with; 1 for near silence."""
    level = samples.groupBy(KEY).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))
    raw = F.when(F.col("rms") < 0.015, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), clip(target_db - 20 * F.log10(F.greatest("rms", F.lit(1e-12))), -30.0, 12.0) / 20))
    level = level.withColumn("raw", raw)
    gain = F.when((F.col("rms") >= 0.015) & (F.col("peak") * F.col("raw") > 0.95), 0.95 / F.col("peak")).otherwise(F.col("raw"))
    return level.select(KEY, "rms", "peak", gain.alias("gain"))


def normalize_loudness(samples: DataFrame, target_db: float = -20.0) -> DataFrame:
    """Scale each recording towards a loudness without clipping."""
    return samples.join(loudness_gain(samples, target_db).select(KEY, "gain"), KEY).withColumn("x", clip(F.col("x") * F.col("gain"), -1.0, 1.0)).drop("gain")


def acoustic_stats(samples: DataFrame) -> DataFrame:
    """n, peak, peak and RMS level, clipping flag and crest of each recording."""
    got = samples.groupBy(KEY).agg(F.count("*").alias("n"), F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return got.select(KEY, "n", "peak", decibels(F.col("peak")).alias("peak_dbfs"), decibels(F.col("rms")).alias("rms_dbfs"), (F.col("peak") >= 0.999).alias("is_clipped"))


def zero_crossing_rate(samples: DataFrame) -> DataFrame:
    """Half the mean absolute step of the sign; a zero sample has sign 0."""
    order = Window.partitionBy(KEY).orderBy("idx")
    step = F.abs(F.signum("x") - F.lag(F.signum("x")).over(order))
    return samples.select(KEY, step.alias("step")).groupBy(KEY).agg(F.coalesce(F.avg("step") / 2, F.lit(0.0)).alias("zcr"))
