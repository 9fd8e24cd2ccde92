"""Evaluation of scores against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: counts and rates of (label, score); rates with nothing below the line are 0."""
    hit = F.col("score") >= threshold
    yes = F.col("label") == 1
    got = scored.agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return got.select("tp", "fp", "fn", "tn", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fp, fp + tn).alias("fpr"), share(fn, fn + tp).alias("fnr"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the curve by rank sums: tied scores are one group and get half. One row; 0.5 without both labels.

    Scores are counted first; running sums are then over distinct scores, in ranges with a sum for each range, so no task
    holds all of them.
    """
    counts = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    dealt = counts.withColumn("part", F.floor(F.col("score") * 1000))
    before = dealt.groupBy("part").agg(F.sum("q").alias("pq"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 1001 rows
    before = before.select("part", F.coalesce(F.sum("pq").over(order), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = dealt.withColumn("run", F.coalesce(F.sum("q").over(own), F.lit(0))).join(before, "part").withColumn("below", F.col("base") + F.col("run"))
    got = below.agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return got.select(F.coalesce("np", F.lit(0)).alias("positives"), F.coalesce("nq", F.lit(0)).alias("negatives"), F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("u") / (F.col("np") * F.col("nq"))).otherwise(0.5).alias("auc"))


def acceptance(scored: DataFrame) -> DataFrame:
    """Passed and total of each category (human, ai, silence, ambiguous) from (category, verdict, score)."""
    s, v = F.col("score"), F.col("verdict")
    good = F.when(F.col("category") == "human", (v == "REAL") | (s < 0.4)).when(F.col("category") == "ai", (v == "SYNTHETIC") | (s >= 0.6))
    good = good.when(F.col("category") == "silence", v == "NO_SPEECH").otherwise(s.between(0.4, 0.6) | (v == "UNCERTAIN"))
    return scored.groupBy("category").agg(F.count("*").alias("total"), F.count_if(good).alias("passed"), F.round(F.avg("score"), 6).alias("mean_score"))


def window_consistency(windows: DataFrame) -> DataFrame:
    """(recording_id, median, deviation, consistency) of window scores: 1 - 2 deviations, clipped."""
    got = windows.groupBy("recording_id").agg(F.count("*").alias("n"), F.percentile("score", 0.5).alias("median"), F.stddev_pop("score").alias("deviation"))
    return got.select("recording_id", "n", "median", "deviation", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2 * F.col("deviation"))).alias("consistency"))
