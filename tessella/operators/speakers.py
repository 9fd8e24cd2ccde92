"""Speaker registry: enrolment as an ordered fold, claims as a lookup, similarity as a cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clip


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(v: Column) -> Column:
    """The vector at length one; unchanged if its length is 0."""
    size = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x))
    return bound(v, lambda w: bound(size(w), lambda n: F.transform(w, lambda x: F.when(n > 0, x / n).otherwise(x))))


def enroll(samples: DataFrame) -> DataFrame:
    """(speaker_id, sample_count, voiceprint) from (speaker_id, sample_no, embedding).

    Each sample moves the voiceprint to unit((v * n + e) / (n + 1)). The fold depends on the order, so a speaker's
    samples meet in one task; they are enrolment recordings of one person.
    """
    ordered = F.array_sort(F.collect_list(F.struct("sample_no", "embedding")))
    got = samples.groupBy("speaker_id").agg(ordered.alias("s"))
    empty = F.struct(F.lit(0.0).alias("n"), F.array().cast("array<double>").alias("v"))

    def step(a: Column, x: Column) -> Column:
        e = unit(x["embedding"])
        moved = unit(F.zip_with(a["v"], e, lambda v, w: (v * a["n"] + w) / (a["n"] + 1)))
        return F.struct((a["n"] + 1).alias("n"), F.when(a["n"] == 0, e).otherwise(moved).alias("v"))

    folded = got.select("speaker_id", F.aggregate("s", empty, step).alias("r"))
    return folded.select("speaker_id", F.col("r.n").cast("long").alias("sample_count"), F.col("r.v").alias("voiceprint"))


def similarity(a: Column, b: Column) -> Column:
    """Cosine on a scale from 0 to 1; 0.5 where either vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return clip((F.when(size > 0, dot(a, b) / size).otherwise(0.0) + 1) / 2, 0.0, 1.0)


def verify_claims(claims: DataFrame, speakers: DataFrame, threshold: float = 0.75) -> DataFrame:
    """claims (claim_id, speaker_id, embedding) against the registry (speaker_id, voiceprint).

    No claim matches; an unknown speaker is an impersonation. Spark sends the registry to all executors if it is small and
    shuffles both sides if it is not.
    """
    known = speakers.select("speaker_id", "voiceprint")
    rows = claims.join(known, "speaker_id", "left")
    none, unknown = F.coalesce(F.col("speaker_id"), F.lit("")) == "", F.col("voiceprint").isNull()
    s = F.when(none, F.lit(1.0)).when(unknown, F.lit(0.0)).otherwise(similarity(F.col("embedding"), F.col("voiceprint")))
    confidence = F.when(none, F.lit(0.5)).when(unknown, F.lit(0.6)).otherwise(clip(0.6 + 0.8 * F.abs(s - threshold), 0.0, 1.0))
    return rows.select("claim_id", "speaker_id", (none | (s >= threshold)).alias("is_match"), s.alias("similarity"), (~none & (s < threshold)).alias("impersonation"), confidence.alias("confidence"))
