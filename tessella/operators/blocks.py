"""Recordings in blocks of bounded size, with the samples around them that frames reach into.

A block row holds recording_id, block, n (samples of the recording), start (index of its first sample, halo included) and samples. Block b owns
the samples from b * size on; `before` and `after` samples more are there where the recording has them. Long recordings are thus spread over
tasks, and what spans blocks is merged from small results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "recording_id"
SCHEMA = "recording_id long, block long, n long, start long, samples array<double>"
#: Bytes of samples that one Arrow batch of blocks holds, about.
BATCH = 4 << 20


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """A column of float lists."""
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0)]).astype(float)))


def rows_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column as arrays, without Python floats between; null lists are empty."""
    flat = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    for k in range(len(column)):
        yield flat[offsets[k] : offsets[k + 1]]


def dealt(rows: DataFrame, key: str = KEY) -> DataFrame:
    """The rows, dealt by key where the input comes in fewer splits than there are cores, as for a small table in one file; larger inputs stay where they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores, key) if rows.rdd.getNumPartitions() < 2 * cores else rows


def sample_blocks(samples: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Blocks of samples (recording_id, idx, x), idx from 0 without gaps; one shuffle of the samples, by recording and block."""
    n = samples.groupBy(KEY).agg(F.count("*").alias("n"))
    first = F.greatest(F.floor((F.col("idx") - after) / size), F.lit(0).cast("long"))
    last = F.least(F.floor((F.col("idx") + before) / size), F.floor((F.col("n") - 1) / size))
    dealt = samples.join(n, KEY).withColumn("block", F.explode(F.sequence(first, last)))
    got = dealt.groupBy(KEY, "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s"))
    return got.select(KEY, "block", "n", F.col("s")[0]["idx"].alias("start"), F.col("s.x").cast("array<double>").alias("samples"))


def pcm_blocks(contents: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Blocks of recordings (recording_id, content) of unsigned 8-bit PCM; null and empty contents have none. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            ids, block, n, start, samples = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, block, n, start)] + [lists(list(samples))], ["recording_id", "block", "n", "start", "samples"])

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for rid, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8) if content.is_valid else np.zeros(0, np.uint8)
                for block in range(-(-len(raw) // size)):
                    start = max(0, block * size - before)
                    part = (raw[start : (block + 1) * size + after].astype(float) - 128) / 128
                    rows.append((rid, block, len(raw), start, part))
                    held += 8 * len(part)
                    if held >= BATCH:
                        yield emit()
                        rows, held = [], 0
        if rows:
            yield emit()

    return contents.select(F.col(KEY).cast("long").alias(KEY), "content").mapInArrow(run, SCHEMA)


def array_blocks(recordings: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Blocks of recordings (recording_id, samples) that are rows already, such as windows of a stream. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, x in zip(batch.column(0).to_pylist(), rows_of(batch.column(1)), strict=True):
                starts = [max(0, b * size - before) for b in range(-(-len(x) // size))]
                parts = [x[s : (b + 1) * size + after] for b, s in enumerate(starts)]
                if parts:
                    k = len(parts)
                    columns = ([rid] * k, range(k), [len(x)] * k, starts)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + [lists(parts)], ["recording_id", "block", "n", "start", "samples"])

    return recordings.select(F.col(KEY).cast("long").alias(KEY), F.col("samples").cast("array<double>").alias("samples")).mapInArrow(run, SCHEMA)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of batches sorted by keys: a key's rows come in one or more parts, one after another."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(k).to_numpy() for k in keys])
        ends = [*(np.flatnonzero(np.any(own[:, 1:] != own[:, :-1], axis=0)) + 1).tolist(), batch.num_rows]
        start = 0
        for end in ends:
            yield tuple(own[:, start].tolist()), batch.slice(start, end - start)
            start = end


def changed(raw: np.ndarray, kind: int, source: int) -> np.ndarray:
    """Unsigned 8-bit samples as they are (kind 0), louder or softer by 0.65 to 1.35 (1), or with normal noise of 0.001 to 0.006 (2), drawn by the source."""
    if not kind:
        return raw
    rng = np.random.default_rng([source, kind])
    x = (raw.astype(float) - 128) / 128
    x = x * rng.uniform(0.65, 1.35) if kind == 1 else x + rng.normal(0, rng.uniform(0.001, 0.006), len(x))
    return np.clip(np.round(x * 128) + 128, 0, 255).astype(np.uint8)


def augmented(content: str, kind: str, source: str):
    """`changed` over columns."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def change(contents, kinds, sources):
        out = [raw if raw is None or not k else changed(np.frombuffer(raw, np.uint8), int(k), int(s)).tobytes() for raw, k, s in zip(contents, kinds, sources, strict=True)]
        return contents.__class__(out, dtype=object)

    return change(content, kind, source)


def voice(chunks: DataFrame, rate: int = 16000) -> DataFrame:
    """The chunks (content: samples of a window of bounded length) with the share of each that lies in speech segments, in place of their content."""
    from ..functions.activity import speech_share

    names = [c for c in chunks.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [speech_share((np.frombuffer(raw or b"", np.uint8).astype(float) - 128) / 128, rate) for raw in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shares, pa.float64())], [*names, "speech_ratio"])

    kinds = dict(chunks.dtypes)
    return chunks.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", speech_ratio double")
