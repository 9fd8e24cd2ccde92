"""Voicing: the decision for each frame, ratios that tell speech from music, and held notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "recording_id"


def frame_voicing(strength: Column, f0: Column, band: Column, zcr: Column, db: Column, threshold_db: Column) -> Column:
    """voiced, unvoiced or silent: periodic frames in the range of a voice, then noisy ones with enough energy in the speech band."""
    quiet = (db < threshold_db) | (db < -52)
    voiced = (strength >= 0.30) & f0.between(75, 420) & (band >= 0.20)
    return F.when(quiet, "silent").when(voiced, "voiced").when((zcr >= 0.12) & (band >= 0.16), "unvoiced").otherwise("silent")


def music_ratios(frames: DataFrame) -> DataFrame:
    """Share of frames of low energy (under 0.35 of the mean) and of noisy frames (zcr over 0.12), from (recording_id, energy, zcr)."""
    mean = frames.groupBy(KEY).agg(F.avg("energy").alias("mean"))
    got = frames.join(mean, KEY).groupBy(KEY)
    return got.agg(F.avg((F.col("energy") < 0.35 * F.col("mean")).cast("int")).alias("low_energy_ratio"), F.avg((F.col("zcr") > 0.12).cast("int")).alias("consonant_ratio"))


def held_notes(contour: DataFrame, least: int = 24, tolerance: float = 0.04) -> DataFrame:
    """(recording_id, n, held, notes): frames in notes held for `least` frames, and how many distinct pitches they have.

    A note goes on while the pitch stays within `tolerance` of its first; the fold depends on the order, so a recording's contour
    (a number for each hop) meets in one task.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "f0"))), lambda r: r["f0"])
    empty = F.struct(F.lit(0.0).alias("pitch"), F.lit(0).alias("hold"), F.lit(0).alias("held"), F.array().cast("array<double>").alias("notes"))

    def end(a: Column, pitch: Column, hold: Column) -> Column:
        """The note is over: count it if it was held."""
        long = a["hold"] >= least
        new = long & ~F.exists(a["notes"], lambda n: F.abs(a["pitch"] - n) / n < tolerance)
        notes = F.when(new, F.concat(a["notes"], F.array(a["pitch"]))).otherwise(a["notes"])
        return F.struct(pitch.alias("pitch"), hold.alias("hold"), (a["held"] + F.when(long, a["hold"]).otherwise(0)).alias("held"), notes.alias("notes"))

    def step(a: Column, p: Column) -> Column:
        same = (p > 0) & (a["pitch"] > 0) & (F.abs(p - a["pitch"]) / a["pitch"] < tolerance)
        on = F.struct(a["pitch"].alias("pitch"), (a["hold"] + 1).alias("hold"), a["held"].alias("held"), a["notes"].alias("notes"))
        return F.when(same, on).otherwise(end(a, F.greatest(p, F.lit(0.0)), F.when(p > 0, F.lit(1)).otherwise(F.lit(0))))

    folded = contour.groupBy(KEY).agg(F.count("*").alias("n"), ordered.alias("f")).select(KEY, "n", F.aggregate("f", empty, step, lambda a: end(a, F.lit(0.0), F.lit(0))).alias("r"))
    return folded.select(KEY, "n", F.col("r.held").cast("long").alias("held"), F.size("r.notes").cast("long").alias("notes"))


def is_music(held: DataFrame, hop_seconds: float = 0.015) -> Column:
    """Three or more held pitches in over 30 % of the recording."""
    return (held["notes"] >= 3) & (held["held"] * hop_seconds >= 0.30 * held["n"] * hop_seconds)
