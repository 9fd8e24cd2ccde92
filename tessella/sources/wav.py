"""WAV recordings: a reader and a writer for RIFF bytes, and a Spark source over folders of them.

PCM of 8, 16, 24 and 32 bits and IEEE floats of 32 and 64 bits are read; compressed codecs need a decoder that is not part of this library.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Format tags.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """(samples by channel, rate, bits) of RIFF bytes; ValueError for what is not a readable WAV."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            if at + 24 > len(data) or size < 16:
                raise ValueError("the format is cut short")
            form = struct.unpack_from("<HHIIHH", data, at + 8)
            if form[0] == EXTENSIBLE:
                if at + 34 > len(data) or size < 26:
                    raise ValueError("the format is cut short")
                form = (struct.unpack_from("<H", data, at + 32)[0], *form[1:])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or body is None or not form[1]:
        raise ValueError("the file has no format or no data")
    tag, channels, rate, _, _, bits = form
    if tag == FLOAT and bits in (32, 64):
        x = np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"<f{bits // 8}").astype(float)
    elif tag == PCM and bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    elif tag == PCM and bits == 24:
        raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / float(1 << 23)
    elif tag == PCM and bits in (16, 32):
        x = np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"<i{bits // 8}") / float(1 << (bits - 1))
    else:
        raise ValueError(f"unknown encoding: tag {tag}, {bits} bits")
    return x[: len(x) // channels * channels].reshape(-1, channels), rate, bits


def encode(x: np.ndarray, rate: int) -> bytes:
    """Samples in [-1, 1], by channel or mono, as 16-bit PCM."""
    x = np.atleast_2d(np.asarray(x, float).T).T
    body = np.rint(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    form = struct.pack("<HHIIHH", PCM, x.shape[1], rate, rate * 2 * x.shape[1], 2 * x.shape[1], 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body


DECODED = "path string, label string, sample_rate int, channels int, bits int, n long, samples array<float>, error string"


def decode_column(files: DataFrame) -> DataFrame:
    """(path, content) to mono samples with their metadata; a file that cannot be read has an error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                parts = path.rstrip("/").split("/")
                label = parts[-2] if len(parts) > 1 else None
                try:
                    x, rate, bits = decode(content or b"")
                    row = [path, label, rate, x.shape[1], bits, len(x), x.mean(1).astype(np.float32), None]
                except ValueError as e:
                    row = [path, label, None, None, None, 0, np.zeros(0, np.float32), str(e)]
                types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in DECODED.split(", ")])

    return files.select("path", "content").mapInArrow(run, DECODED)


def header(head: bytes, size: int) -> tuple[int, int, int, int]:
    """(rate, channels, bits, bytes of samples) from the beginning of a file of `size` bytes; ValueError if it has no WAV header there."""
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(head):
        name, n = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt ":
            if at + 24 > len(head) or n < 16:
                raise ValueError("the format is cut short")
            form = struct.unpack_from("<HHIIHH", head, at + 8)
        elif name == b"data" and form and form[1] and form[2] and form[5]:
            return form[2], form[1], form[5], min(n, size - at - 8)
        at += 8 + n + n % 2
    raise ValueError("the file has no format or no data")


def probe(files: DataFrame) -> DataFrame:
    """audio_id, container, rate, channels, bits, duration_sec and bitrate_kbps of files (audio_id, head, size), where head is a file's beginning; `unreadable` where it is no WAV header."""
    names = ["audio_id", "container", "rate", "channels", "bits", "duration_sec", "bitrate_kbps"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for audio_id, head, size in zip(*(batch.column(c).to_pylist() for c in ("audio_id", "head", "size")), strict=True):
                try:
                    rate, channels, bits, n = header(head or b"", size or 0)
                    rows.append((audio_id, "WAV", rate, channels, bits, n * 8 / (bits * channels * rate), bits * channels * rate / 1000))
                except ValueError:
                    rows.append((audio_id, "unreadable", None, None, None, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select(F.col("audio_id").cast("long").alias("audio_id"), "head", "size").mapInArrow(run, "audio_id long, container string, rate int, channels int, bits int, duration_sec double, bitrate_kbps double")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Recordings under a folder; the name of the folder a file is in is its label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return decode_column(files.select("path", "content"))


def to_samples(recordings: DataFrame, key: str = "path") -> DataFrame:
    """Recordings in rows (recording_id, idx, x)."""
    return recordings.select(F.col(key).alias("recording_id"), F.posexplode("samples").alias("idx", "x")).withColumn("x", F.col("x").cast("double"))
