"""Framing: hop frames, sliding chunks, and overlap of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clip

KEY = "recording_id"


def hop_frames(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """Each sample with every frame it lies in: frame f covers idx f * hop to f * hop + size - 1.

    The frames of a sample follow from its own idx, so this needs no shuffle; incomplete frames at the end are
    dropped by `frame_levels`, which counts.
    """
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("idx") - (size - 1)) / hop))
    return samples.withColumn("frame_idx", F.explode(F.sequence(first, F.floor(F.col("idx") / hop))))


def frame_levels(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """start_idx, rms, db and peak of each whole frame; one shuffle by recording and frame, with partial sums before it."""
    framed = hop_frames(samples, size, hop).groupBy(KEY, "frame_idx")
    got = framed.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-12).alias("rms"), F.max(F.abs("x")).alias("peak")).where(F.col("n") == size)
    return got.select(KEY, "frame_idx", (F.col("frame_idx") * hop).alias("start_idx"), "rms", (20 * F.log10("rms")).alias("db"), "peak")


def frame_zcr(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """Zero-crossing rate within each whole frame."""
    order = Window.partitionBy(KEY).orderBy("idx")
    stepped = samples.withColumn("step", F.abs(F.signum("x") - F.lag(F.signum("x")).over(order)))
    inside = F.when(F.col("idx") > F.col("frame_idx") * hop, F.col("step"))
    got = hop_frames(stepped, size, hop).groupBy(KEY, "frame_idx").agg(F.count("*").alias("n"), (F.avg(inside) / 2).alias("zcr"))
    return got.where(F.col("n") == size).drop("n")


def sliding_chunks(lengths: DataFrame, window: int, hop: int, least: int) -> DataFrame:
    """Chunks of recordings (recording_id, n): chunk_index, start, end, is_padded.

    A recording shorter than the window is one padded chunk if it has `least` samples. A tail that
    no window has covered is a padded chunk of its own if it has `least` samples.
    """
    n = F.col("n")
    whole = F.when(n >= window, F.floor((n - window) / hop) + 1).otherwise(F.lit(0))
    covered = F.when(whole > 0, (whole - 1) * hop + window).otherwise(F.lit(0))
    tail = (covered < n) & (n - whole * hop >= least)
    total = whole + F.when(tail, 1).otherwise(0)
    rows = lengths.where(total > 0).withColumn("whole", whole).select(KEY, "n", "whole", F.explode(F.sequence(F.lit(0).cast("long"), total.cast("long") - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * hop
    return rows.select(KEY, "chunk_index", start.alias("start_idx"), F.least(start + window, n).alias("end_idx"), (F.col("chunk_index") >= F.col("whole")).alias("is_padded"))


def overlap(chunks: DataFrame, segments: DataFrame, cell: int) -> DataFrame:
    """(recording_id, chunk_index, covered): how much of each chunk lies in the speech segments.

    Both sides are dealt into cells of `cell` samples, and an interval pair meets in the cell where the later of
    the two begins, so the join is an equi-join on (recording, cell) whatever a recording's length, and counts each pair once.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell)))
    left = chunks.where("end_idx > start_idx").withColumn("cell", cells("start_idx", "end_idx"))
    right = segments.where("is_speech AND end_idx > start_idx").select(KEY, F.col("start_idx").alias("s"), F.col("end_idx").alias("e")).withColumn("cell", cells("s", "e"))
    both = left.join(right, [KEY, "cell"]).where((F.col("s") < F.col("end_idx")) & (F.col("start_idx") < F.col("e")))
    both = both.where(F.floor(F.greatest("start_idx", "s") / cell) == F.col("cell"))
    return both.groupBy(KEY, "chunk_index").agg(F.sum(F.least("e", "end_idx") - F.greatest("s", "start_idx")).alias("covered"))


def chunk_speech_ratio(chunks: DataFrame, segments: DataFrame, cell: int) -> DataFrame:
    """speech_ratio and contains_speech of each chunk; a recording without any segment counts as all speech."""
    known = segments.select(KEY).distinct().withColumn("known", F.lit(True))
    got = chunks.join(overlap(chunks, segments, cell), [KEY, "chunk_index"], "left").join(known, KEY, "left")
    length = F.col("end_idx") - F.col("start_idx")
    ratio = F.when(F.col("known").isNull(), F.lit(1.0)).when(length <= 0, F.lit(0.0)).otherwise(clip(F.coalesce("covered", F.lit(0)) / length, 0.0, 1.0))
    return got.select(*chunks.columns, F.round(ratio, 3).alias("speech_ratio"), (F.col("known").isNull() | (ratio > 0.05)).alias("contains_speech"))


def speech_only(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """The samples that lie in a speech segment, renumbered in order; overlapping segments repeat their samples."""
    spans = segments.where("is_speech AND end_idx > start_idx").select(KEY, "segment_id", F.explode(F.sequence("start_idx", F.col("end_idx") - 1)).alias("idx"))
    order = Window.partitionBy(KEY).orderBy("segment_id", "idx")
    return samples.join(spans, [KEY, "idx"]).select(KEY, (F.row_number().over(order) - 1).alias("pos"), "idx", "x")
