"""Perturbation and rhythm: statistics of neighbouring periods, amplitudes and pitch values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"


def perturbation(series: DataFrame, value: str, name: str) -> DataFrame:
    """Local, three-point and five-point perturbation in percent, and mean absolute step in dB; 0 for fewer than five values."""
    order = Window.partitionBy(KEY).orderBy("idx")
    around = lambda k: F.when(F.count(value).over(order.rowsBetween(-k, k)) == 2 * k + 1, F.abs(F.col(value) - F.avg(value).over(order.rowsBetween(-k, k))))
    before = F.lag(value).over(order)
    rows = series.select(
        KEY, F.col(value).alias("v"), F.abs(F.col(value) - before).alias("d1"), around(1).alias("d3"), around(2).alias("d5"),
        F.when((F.col(value) > 0) & (before > 0), F.abs(20 * F.log10(F.col(value) / before))).alias("db"),
    )
    got = rows.groupBy(KEY).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), *[F.avg(c).alias(c) for c in ("d1", "d3", "d5", "db")])
    good = (F.col("n") >= 5) & (F.col("mean") > 0)
    share = lambda c: F.when(good, F.coalesce(F.col(c) / F.col("mean") * 100, F.lit(0.0))).otherwise(F.lit(0.0))
    return got.select(KEY, share("d1").alias(f"{name}_local_pct"), share("d3").alias(f"{name}_three_pct"), share("d5").alias(f"{name}_five_pct"), F.when(good, F.coalesce("db", F.lit(0.0))).otherwise(F.lit(0.0)).alias(f"{name}_db"))


def pairwise_variability(series: DataFrame, value: str) -> DataFrame:
    """(recording_id, rpvi, npvi): mean absolute step of durations, raw and as percent of the pair's mean."""
    order = Window.partitionBy(KEY).orderBy("idx")
    before = F.lag(value).over(order)
    step = F.abs(F.col(value) - before)
    pair = (F.col(value) + before) / 2
    rows = series.select(KEY, step.alias("step"), F.when(pair > 0, step / pair).alias("share"))
    return rows.groupBy(KEY).agg(F.coalesce(F.avg("step"), F.lit(0.0)).alias("rpvi"), F.coalesce(100 * F.avg("share"), F.lit(0.0)).alias("npvi"))


def pitch_stats(contour: DataFrame) -> DataFrame:
    """Mean, deviation, least and largest voiced pitch (0 with fewer than two), and the voiced share."""
    voiced = F.when(F.col("f0") > 0, F.col("f0"))
    got = contour.groupBy(KEY).agg(F.count("*").alias("n"), F.count(voiced).alias("k"), F.avg(voiced).alias("a"), F.stddev_pop(voiced).alias("s"), F.min(voiced).alias("lo"), F.max(voiced).alias("hi"))
    enough = lambda c: F.when(F.col("k") >= 2, F.col(c)).otherwise(F.lit(0.0))
    return got.select(KEY, enough("a").alias("mean_f0"), enough("s").alias("std_f0"), enough("lo").alias("min_f0"), enough("hi").alias("max_f0"), (F.col("k") / F.col("n")).alias("voiced_fraction"))


def intonation(contour: DataFrame, step_sec: float = 0.01, monotone_below: float = 1.5) -> DataFrame:
    """Pitch range in semitones (5th to 95th percentile), slope statistics and the monotone flag; zeros under five voiced values."""
    order = Window.partitionBy(KEY).orderBy("idx")
    voiced = contour.where("f0 > 0").select(KEY, "idx", "f0", (12 * F.log2(F.col("f0") / 100)).alias("st"))
    rows = voiced.withColumn("slope", (F.col("f0") - F.lag("f0").over(order)) / step_sec)
    got = rows.groupBy(KEY).agg(F.count("*").alias("n"), (F.percentile("st", 0.95) - F.percentile("st", 0.05)).alias("r"), F.avg("slope").alias("m"), F.var_pop("slope").alias("v"))
    enough = lambda c: F.when(F.col("n") >= 5, F.col(c)).otherwise(F.lit(0.0))
    return got.select(KEY, enough("r").alias("range_semitones"), enough("m").alias("mean_slope"), enough("v").alias("slope_variance"), ((F.col("n") >= 5) & (F.col("r") < monotone_below)).alias("is_monotone"))


def pitch_turns(contour: DataFrame, flat: float = 10.0) -> DataFrame:
    """Sign changes of the voiced pitch's steps, steps of at most `flat` left out."""
    order = Window.partitionBy(KEY).orderBy("idx")
    steps = contour.where("f0 > 0").withColumn("step", F.col("f0") - F.lag("f0").over(order)).where(F.abs("step") > flat)
    turned = steps.withColumn("turn", (F.signum("step") != F.lag(F.signum("step")).over(order)).cast("int"))
    return turned.groupBy(KEY).agg(F.coalesce(F.sum("turn"), F.lit(0)).alias("turns"))


def splice_points(levels: DataFrame, jump_db: float) -> DataFrame:
    """(recording_id, max_jump_db, splice_points): level steps between neighbouring frames."""
    order = Window.partitionBy(KEY).orderBy("frame_idx")
    jump = F.abs(F.col("db") - F.lag("db").over(order))
    return levels.select(KEY, jump.alias("jump")).groupBy(KEY).agg(F.coalesce(F.max("jump"), F.lit(0.0)).alias("max_jump_db"), F.count_if(F.col("jump") > jump_db).alias("splice_points"))


def speaking_rate(levels: DataFrame, peak_db: float, frame_sec: float = 0.01) -> DataFrame:
    """Syllables as strict local peaks of the level, their rate over all time and over the time above the level."""
    order = Window.partitionBy(KEY).orderBy("frame_idx")
    peak = (F.col("db") > F.lag("db").over(order)) & (F.col("db") > F.lead("db").over(order)) & (F.col("db") >= peak_db)
    got = levels.select(KEY, F.coalesce(peak, F.lit(False)).alias("peak"), (F.col("db") >= peak_db).alias("loud")).groupBy(KEY)
    got = got.agg(F.count_if("peak").alias("syllables"), F.count("*").alias("n"), F.count_if("loud").alias("k"))
    rate = lambda c: F.when(F.col(c) > 0, F.col("syllables") / (F.col(c) * frame_sec)).otherwise(F.lit(0.0))
    return got.select(KEY, "syllables", rate("n").alias("speaking_rate"), rate("k").alias("articulation_rate"))
