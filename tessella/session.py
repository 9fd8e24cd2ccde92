"""A session with the settings that the library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; everything else as the cluster has it."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
