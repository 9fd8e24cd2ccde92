"""Ingestion of audio files as one flow: hash, archive, decode, clean-up, voice activity and chunks, a record for each file.

A file is one row and is worked on where its content is; samples leave a task only as the record's own columns. A file that cannot be read keeps its
hash and its place in the archive, and has an error in place of everything else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import activity, kernels
from ..functions.resample import polyphase
from ..sources import wav
from . import reports
from .blocks import KEY, lists, rows_of
from .recurrence import Runner, cascade

RATE, TARGET_DB, CEILING = 16000, -20.0, 0.95
#: The high-pass is designed for RATE and runs before resampling.
DC = kernels.butterworth(1, 20.0, RATE, "high")
_DC_RUNNER = Runner(cascade(DC))
CHUNK_SEC, HOP_SEC, LEAST_SEC = 3.0, 1.0, 0.5

RECORD = (
    "audio_id long, source_rate int, channels int, bit_depth int, source_samples long, peak_dbfs double, rms_dbfs double, is_clipped boolean, samples array<double>, "
    "segments array<struct<start_sample:long,end_sample:long,is_speech:boolean>>, speech_sec double, silence_sec double, speech_ratio double, "
    "chunks array<struct<start_sample:long,end_sample:long,speech_ratio:double,is_padded:boolean>>, error string"
)


def preprocess(x: np.ndarray, rate: int) -> np.ndarray:
    """Mono samples (or a column for each channel) at RATE without offset and at a level of TARGET_DB; near silence keeps its level."""
    x = x.mean(axis=1) if x.ndim == 2 else x
    if not len(x):
        return np.zeros(0)
    x = np.where(np.isfinite(x), x, 0.0)
    x = x - x.mean()
    if len(x) > 64:
        x, _ = _DC_RUNNER.run(x, np.zeros(2))
    x = polyphase(x, rate, RATE)
    rms = np.sqrt((x * x).mean())
    if rms < 0.015:
        return x
    x = x * 10 ** (min(12.0, max(-30.0, TARGET_DB - 20 * np.log10(rms))) / 20)
    peak = np.abs(x).max()
    return np.clip(x * (CEILING / peak) if peak > CEILING else x, -1.0, 1.0)


def chunks_of(n: int, spans: list[tuple[int, int, bool]], rate: int = RATE) -> list[tuple[int, int, float, bool]]:
    """(start, end, speech ratio, padded) of the sliding chunks of n samples: whole windows, then a tail that no window has covered."""
    size, hop, least = int(CHUNK_SEC * rate), int(HOP_SEC * rate), int(LEAST_SEC * rate)
    starts = list(range(0, n - size + 1, hop))
    covered = starts[-1] + size if starts else 0
    tail = len(starts) * hop
    if covered < n and n - tail >= least:
        starts.append(tail)
    out = []
    for a in starts:
        b = min(n, a + size)
        spoken = sum(max(0, min(b, e) - max(a, s)) for s, e, on in spans if on)
        out.append((a, b, round(min(1.0, spoken / (b - a)), 3), b - a < size))
    return out


def _level(v: float) -> float:
    return round(20 * float(np.log10(v)), 2) if v > 1e-7 else -100.0


def _record(content: bytes | None) -> tuple:
    x, rate, bits = wav.decode(content or b"")
    if rate <= 0:
        raise ValueError("the rate is not positive")
    mono = x.mean(axis=1) if len(x) else np.zeros(0)
    peak = float(np.abs(x).max()) if x.size else 0.0
    y = preprocess(x, rate)
    spans = activity.segments(y, RATE)
    spoken, silent = (sum(b - a for a, b, on in spans if on == what) / RATE for what in (True, False))
    share = min(1.0, spoken / (len(y) / RATE)) if len(y) else 0.0
    rms = float(np.sqrt((mono * mono).mean())) if len(mono) else 0.0
    return rate, x.shape[1], bits, len(x), _level(peak), _level(rms), peak >= 0.999, y, spans, round(spoken, 3), round(silent, 3), round(share, 3), chunks_of(len(y), spans), None


#: Samples that are held before they are handed on.
HELD = 1 << 17


def records(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """RECORD of each (audio_id, content); columns to keep stand after the number."""
    names = ["audio_id", "source_rate", "channels", "bit_depth", "source_samples", "peak_dbfs", "rms_dbfs", "is_clipped", "samples", "segments", "speech_sec", "silence_sec", "speech_ratio", "chunks", "error"]
    segment = pa.list_(pa.struct([("start_sample", pa.int64()), ("end_sample", pa.int64()), ("is_speech", pa.bool_())]))
    chunk = pa.list_(pa.struct([("start_sample", pa.int64()), ("end_sample", pa.int64()), ("speech_ratio", pa.float64()), ("is_padded", pa.bool_())]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), None, segment, pa.float64(), pa.float64(), pa.float64(), chunk, pa.string()]
    rows = files.select(F.col("audio_id").cast("long").alias("audio_id"), *keep, "content")
    kept = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in keep}
    schema = RECORD.replace("audio_id long", ", ".join(["audio_id long", *[f"{c} {kept[c]}" for c in keep]]), 1)

    def keyed(of_rows: list, kind: pa.DataType) -> pa.Array:
        """The rows' lists of tuples as lists of structs."""
        flat = [r for own in of_rows for r in own or ()]
        fields = [pa.array([r[k] for r in flat], f.type) for k, f in enumerate(kind.value_type)]
        ends = np.cumsum([0, *[len(own or ()) for own in of_rows]])
        values = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([own is None for own in of_rows]))

    def table(held: list, batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        columns = []
        for k, kind in enumerate(kinds):
            own = [row[k] for row in held]
            if k == 8:
                columns.append(pa.ListArray.from_arrays(*_laid(own), mask=pa.array([x is None for x in own])))
            else:
                columns.append(keyed(own, kind) if kind in (segment, chunk) else pa.array(own, kind))
        same = [batch.column(c).slice(at, len(held)) for c in keep]
        return pa.RecordBatch.from_arrays([columns[0], *same, *columns[1:]], [names[0], *keep, *names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n, at = [], 0, 0
            for audio_id, content in zip(batch.column("audio_id").to_pylist(), batch.column("content"), strict=True):
                try:
                    row = [audio_id, *_record(content.as_py())]
                except ValueError as e:
                    row = [audio_id, *[None] * 13, str(e)]
                held.append(row)
                n += len(row[8]) if row[8] is not None else 0
                if n >= HELD:
                    yield table(held, batch, at)
                    held, n, at = [], 0, at + len(held)
            if held:
                yield table(held, batch, at)

    return rows.mapInArrow(run, schema)


def _laid(own: list) -> tuple[pa.Array, pa.Array]:
    """Offsets and values of rows of samples laid end to end; a null row holds none."""
    full = [x for x in own if x is not None]
    ends = np.cumsum([0, *[0 if x is None else len(x) for x in own]])
    return pa.array(ends, pa.int32()), pa.array(np.concatenate([*full, np.zeros(0)]))


def ingest(files: DataFrame, archive: str) -> DataFrame:
    """A record for each file (audio_id, path, content), with its hashes; contents go to the archive byte for byte, and integrity is checked on what was archived.

    The archive is read back once, and a file's hashes and record are made where its content is: nothing is shuffled.
    """
    rows = files.select("audio_id", "path", F.coalesce("content", F.lit(b"")).alias("content"))
    kept = rows.select(
        "audio_id", "path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.octet_length("content").cast("long").alias("n_bytes"),
        reports.archive_name(F.col("audio_id").cast("string"), F.col("path")).alias("archived_as"), "content",
    )
    kept.write.mode("append").parquet(archive)
    back = rows.sparkSession.read.schema(kept.schema).parquet(archive)
    return records(back.withColumn("verified", F.sha2("content", 256) == F.col("sha256")), ("path", "sha256", "md5", "n_bytes", "archived_as", "verified"))


def resampled(blocks: DataFrame, size: int, source: int, target: int) -> DataFrame:
    """(recording_id, block, start, samples) at the target rate from blocks with `reach` samples around them; equal to resampling whole recordings."""
    names = [KEY, "block", "start", "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, out = [], []
            for b, n, s, x in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "start")), rows_of(batch.column("samples")), strict=True):
                low, high = (-(-min(n, k * size) * target // source) for k in (b, b + 1))  # outputs that lie in the block
                first.append(low)
                out.append(polyphase(x, source, target, low, high, s, n))
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("block"), pa.array(first, pa.int64()), lists(out)], names)

    return blocks.mapInArrow(run, "recording_id long, block long, start long, samples array<double>")
