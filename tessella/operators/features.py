"""Feature vectors: assembly, normalisation, and the features that stand out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clip, finite
from ..schema import FEATURES


def vectorize(features: Column, names: list[str]) -> Column:
    """A map of features as an array in fixed order; missing, NaN and infinite become 0."""
    return F.array(*[finite(features[n].cast("double")) for n in names])


def normalize(vector: Column, means: list[float], deviations: list[float], limit: float = 5.0) -> Column:
    """z-scores, clipped."""
    stats = F.arrays_zip(vector.alias("v"), F.array(*map(F.lit, means)).alias("m"), F.array(*map(F.lit, deviations)).alias("s"))
    return F.transform(stats, lambda r: clip((r["v"] - r["m"]) / r["s"], -limit, limit))


def baseline(names: list[str]) -> tuple[list[float], list[float]]:
    return [FEATURES[n][0] for n in names], [FEATURES[n][1] for n in names]


def fit_normalizer(values: DataFrame) -> DataFrame:
    """(feature, mean, deviation) of long rows (feature, value); population deviation, at least 0.0001."""
    return values.groupBy("feature").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(1e-4)).alias("deviation"))


def top_features(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k features of each recording with the largest |z| (of equals, the later one), from long rows (recording_id, pos, feature, z)."""
    order = Window.partitionBy("recording_id").orderBy(F.desc(F.abs("z")), F.desc("pos"))
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("recording_id", "rank", "feature", "z", F.when(F.abs("z") > 1.5, "Synthetic indicator").otherwise("Within normal baseline").alias("impact"))


def top_names(z: Column, names: list[str], k: int = 5) -> Column:
    """The names of the k largest |z| of a row's vector, as `top_features` ranks them, without rows for features."""
    ranked = F.reverse(F.array_sort(F.transform(z, lambda v, pos: F.struct(F.abs(v).alias("size"), pos.alias("pos")))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.element_at(F.array(*map(F.lit, names)), r["pos"] + 1))
