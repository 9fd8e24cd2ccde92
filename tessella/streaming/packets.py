"""Packets of a stream as bytes: the encoding comes with the packet, as bytes alone do not tell it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings of samples, and what a full scale is in each.
ENCODINGS = {"int16": ("<i2", 32768.0), "int32": ("<i4", 2147483648.0), "float32": ("<f4", 1.0), "float64": ("<f8", 1.0), "uint8": ("u1", 128.0)}
#: A chunk that arrives as JSON.
CHUNK = "samples array<double>, sample_rate int, scenario string"


def samples_of(payload: bytes | None, encoding: str | None) -> np.ndarray | None:
    """Samples of a packet; a piece of a sample at the end is left out, what is not finite becomes 0. None for an unknown encoding."""
    if encoding not in ENCODINGS:
        return None
    kind, full = ENCODINGS[encoding]
    raw = payload or b""
    x = np.frombuffer(raw[: len(raw) // np.dtype(kind).itemsize * np.dtype(kind).itemsize], kind).astype(float)
    x = (x - 128) / full if kind == "u1" else x / full  # silence of unsigned samples is in the middle
    return np.where(np.isfinite(x), x, 0.0)


def decoded(payload: Column, encoding: Column) -> Column:
    @F.pandas_udf("array<double>")
    def decode(payloads: pd.Series, encodings: pd.Series) -> pd.Series:
        return pd.Series([samples_of(p, e) for p, e in zip(payloads, encodings, strict=True)], dtype=object)

    return decode(payload, encoding)


def encoded(samples: Column, encoding: Column) -> Column:
    """Bytes of samples within [-1, 1]; integers are rounded to even."""

    @F.pandas_udf("binary")
    def encode(rows: pd.Series, encodings: pd.Series) -> pd.Series:
        out = []
        for x, e in zip(rows, encodings, strict=True):
            kind, full = ENCODINGS[e]
            y = np.clip(np.asarray(x, float), -1, 1)
            out.append((np.round(y * (full - 1) + 128 * (kind == "u1")) if full > 1 else y).astype(kind).tobytes())
        return pd.Series(out, dtype=object)

    return encode(samples, encoding)


def decode_packets(packets: DataFrame) -> DataFrame:
    """Packets with `samples` in place of (payload, encoding), for `hopping_windows`; null where the encoding is not known."""
    names = [c for c in packets.columns if c not in ("payload", "encoding")]
    return packets.select(*names, decoded(F.col("payload"), F.col("encoding")).alias("samples"))


def parse_chunks(rows: DataFrame, body: str = "body") -> DataFrame:
    """JSON chunks as (samples, sample_rate, scenario) beside the other columns; a missing rate is 16000, and a body that cannot be read has no samples."""
    parsed = F.from_json(body, CHUNK)
    rest = [c for c in rows.columns if c != body]
    got = rows.select(*rest, parsed.alias("chunk"))
    return got.select(*rest, F.col("chunk.samples").alias("samples"), F.coalesce("chunk.sample_rate", F.lit(16000)).alias("sample_rate"), F.col("chunk.scenario").alias("scenario"))
