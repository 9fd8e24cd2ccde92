"""Sinks of verdicts and alerts that give each row once, also when a batch runs again.

A micro-batch is written to a folder of its own number, replacing what an earlier attempt at the same batch has left there. A restarted query repeats
its last batch with the same number and the same rows, so nothing is doubled, and readers see whole batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reports

ALERTED = ("MEDIUM", "HIGH", "CRITICAL")
#: Levels that go to the console, and how many lines of a batch the driver prints at most; all of them are in the table.
SHOWN, LINES = ("HIGH", "CRITICAL"), 20


def alerts_of(rows: DataFrame) -> DataFrame:
    """The rows that alert, with the line that a console shows (null below HIGH)."""
    line = reports.console_line(F.col("verdict"), F.round(F.col("probability") * 100, 1), F.col("action"), F.col("factors"))
    return rows.where(F.col("risk_level").isin(*ALERTED)).withColumn("line", F.when(F.col("risk_level").isin(*SHOWN), line))


def write_batch(rows: DataFrame, batch: int, path: str, kind: str = "parquet", show: bool = False) -> None:
    """Write a batch's rows in place of an earlier attempt's."""
    rows.write.mode("overwrite").format(kind).save(f"{path}/batch={batch}")
    if show:
        for r in rows.sparkSession.read.schema(rows.schema).format(kind).load(f"{path}/batch={batch}").where("line IS NOT NULL").select("line").limit(LINES).collect():
            print(r.line)


def alert_sink(verdicts: DataFrame, path: str, progress: str, show: bool = False, **trigger) -> StreamingQuery:
    """A query that writes the alerts of a stream of verdicts."""
    return verdicts.writeStream.foreachBatch(lambda rows, n: write_batch(alerts_of(rows), n, path, show=show)).option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start()


def verdict_sink(verdicts: DataFrame, path: str, progress: str, **trigger) -> StreamingQuery:
    """A query that writes a stream of verdicts as JSON lines, one for each window."""
    return verdicts.writeStream.foreachBatch(lambda rows, n: write_batch(rows, n, path, "json")).option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start()


def read_sink(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """All batches of a sink, with their numbers."""
    return spark.read.schema(f"{schema}, batch long").format(kind).load(path)
