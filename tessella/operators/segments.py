"""Voice-activity segmentation: thresholds, hangover smoothing and runs, as gaps-and-islands over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"


def adaptive_threshold(levels: DataFrame) -> DataFrame:
    """(recording_id, floor_db, threshold_db): from the 15th percentile and the maximum of the frame levels."""
    got = levels.groupBy(KEY).agg(F.percentile("db", 0.15).alias("floor_db"), F.max("db").alias("max_db"))
    base = F.when(F.col("floor_db") < -35, F.greatest(F.lit(-48.0), F.col("floor_db") + 5)).otherwise(F.lit(-48.0))
    return got.select(KEY, "floor_db", F.least(base, F.col("max_db") - 2).alias("threshold_db"))


def runs(flags: DataFrame, flag: str) -> DataFrame:
    """(recording_id, run, value, first, last, length): maximal runs of equal flags in frame order."""
    order = Window.partitionBy(KEY).orderBy("frame_idx")
    changed = F.when(F.lag(flag).over(order).eqNullSafe(F.col(flag)), 0).otherwise(1)
    marked = flags.select(KEY, "frame_idx", F.col(flag).alias("value"), changed.alias("changed")).withColumn("run", F.sum("changed").over(order))
    return marked.groupBy(KEY, "run").agg(F.first("value").alias("value"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.count("*").alias("length"))


def hangover(flags: DataFrame, min_silence: int, min_speech: int) -> DataFrame:
    """(recording_id, frame_idx, is_speech): short gaps between speech are filled, then short bursts are dropped.

    Leading and trailing silence is never filled.
    """
    order = Window.partitionBy(KEY).orderBy("run")
    first = runs(flags, "is_speech")
    inner = F.lag("run").over(order).isNotNull() & F.lead("run").over(order).isNotNull()
    filled = first.withColumn("value", F.col("value") | (~F.col("value") & inner & (F.col("length") <= min_silence)))
    frames = filled.select(KEY, F.explode(F.sequence("first", "last")).alias("frame_idx"), "value")
    second = runs(frames, "value")
    kept = second.withColumn("value", F.col("value") & (F.col("length") >= min_speech))
    return kept.select(KEY, F.explode(F.sequence("first", "last")).alias("frame_idx"), F.col("value").alias("is_speech"))


def segments(flags: DataFrame, lengths: DataFrame, size: int, hop: int) -> DataFrame:
    """Segments of equal flags in samples; a segment ends with its last frame, the last one with the recording."""
    order = Window.partitionBy(KEY).orderBy("run")
    got = runs(flags, "is_speech").join(lengths, KEY)
    end = F.when(F.lead("run").over(order).isNull(), F.col("n")).otherwise(F.col("last") * hop + size)
    return got.select(KEY, (F.row_number().over(order) - 1).cast("long").alias("segment_id"), F.col("value").alias("is_speech"), (F.col("first") * hop).alias("start_idx"), end.alias("end_idx"))


def pause_runs(levels: DataFrame, below: float, least: int) -> DataFrame:
    """(recording_id, pause_count, mean_pause): runs of at least `least` frames under a level, in frames."""
    got = runs(levels.withColumn("quiet", F.col("db") < below), "quiet")
    long = F.when(F.col("value") & (F.col("length") >= least), F.col("length"))
    return got.groupBy(KEY).agg(F.count(long).alias("pause_count"), F.coalesce(F.avg(long), F.lit(0.0)).alias("mean_pause"))


def timeline_bar(flags: DataFrame, width: int = 40) -> DataFrame:
    """A text bar of each recording: # where any frame of a cell is speech, - elsewhere."""
    n = Window.partitionBy(KEY)
    cell = F.floor(F.col("frame_idx") * width / F.col("n"))
    cells = flags.withColumn("n", F.max("frame_idx").over(n) + 1).groupBy(KEY, cell.alias("cell")).agg(F.max(F.col("is_speech").cast("int")).alias("on"))
    on = F.collect_set(F.when(F.col("on") == 1, F.col("cell")))  # at most `width` cells
    bar = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(F.array_contains("cells", k.cast("long")), "#").otherwise("-")), "")
    return cells.groupBy(KEY).agg(on.alias("cells")).select(KEY, bar.alias("bar"))
