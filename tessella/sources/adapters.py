"""Adapters: the star-schema tables seen as recordings, spectra, voiceprints and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed multipliers of the modular arithmetic that makes scores from an order key.
SCORE_STEPS = {"acoustic": 37, "spectral": 53, "prosody": 29, "synthesis_artifacts": 71, "phase": 43, "ml_detector": 61}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, idx, x in about [-0.11, 0.98], amp in (0, 1): a user's events in time order are a recording."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", "value")
    return events.select(
        F.col("user_id").alias("recording_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), ((F.col("value") - 50) / 450).alias("x"),
        (F.col("value") / 500).alias("amp"), "value", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ms"),
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, content: the bytes of a document's text as unsigned 8-bit samples; documents without text are none."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), F.encode("text", "UTF-8").alias("content"))


def contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, idx, f0: pitch contours; error events are unvoiced (0)."""
    return signal(spark, sf_dir).select("recording_id", "idx", F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(50 + F.col("value")).alias("f0"))


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, frame_idx, bin, mag: an embedding is a magnitude spectrum of 64 bins, its label the recording."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("bin", "v"))
    return rows.select(F.col("label").alias("recording_id"), F.col("vec_id").alias("frame_idx"), "bin", F.abs(F.col("v").cast("double")).alias("mag"))


def voiceprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """speaker_id, sample_no, embedding as doubles."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.concat(F.lit("spk_"), "label").alias("speaker_id"), F.col("vec_id").alias("sample_no"), F.col("embedding").cast("array<double>").alias("embedding"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, six modality scores, and the other inputs of the scoring cascade, from order keys."""
    key = F.col("o_orderkey")
    made = [((key * step) % 101 / 100.0).alias(name) for name, step in SCORE_STEPS.items()]
    kind = F.element_at(F.array(*[F.lit(s) for s in ("high_value_transaction", "confidential_disclosure", "standard_support", "general_telephony", "unknown")]), (key % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("recording_id"), *made, kind.alias("scenario"), ((key * 17) % 61 / 10.0).alias("duration_sec"), ((key * 11) % 101 / 100.0 + 0.000037).alias("modality_confidence"),
        ((key * 23) % 101 / 100.0).alias("consistency"), ((key * 13) % 101 / 100.0).alias("window_range"), ((key * 7) % 9).alias("splice_points"), ((key * 3) % 4).alias("n_factors"),
        ((key * 19) % 101 / 100.0).alias("similarity"), (key % 3 == 0).alias("has_claim"), (key % 6 == 0).alias("impersonation"),
    )
