"""Voice embeddings: pooled mel bands projected by a fixed matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spectra
from .blocks import KEY, lists, rows_of

#: Mel bands, statistics of each, length of an embedding, and the seed of the matrix.
MELS, STATS, DIM, SEED = 40, ("mean", "std", "p25", "p75"), 128, 1337
RATE, FFT, HOP = 16000, 512, 160
#: Recordings that are multiplied at once.
ROWS = 2048


def seeded_matrix(spark: SparkSession, inputs: int = MELS * len(STATS), outputs: int = DIM, seed: int = SEED) -> DataFrame:
    """(i, j, w): normal weights over the root of the inputs, the same wherever they are made; a table of fixed size."""
    w = np.random.RandomState(seed).randn(inputs, outputs).astype(np.float32) / np.float32(np.sqrt(inputs))
    i, j = np.divmod(np.arange(inputs * outputs), outputs)
    return spark.createDataFrame(pa.table({"i": i, "j": j, "w": w.ravel().astype(float)}))


def mel_weights(bands: int = MELS, low: float = 50.0) -> np.ndarray:
    """Triangles over the bins, even on the mel scale from `low` Hz to half the rate."""
    to_mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(low), to_mel(RATE / 2), bands + 2) / 2595) - 1)
    hz = np.linspace(0, RATE / 2, FFT // 2 + 1)
    a, c, b = (edges[k : k + bands, None] for k in range(3))
    return np.maximum(0.0, np.minimum((hz - a) / (c - a), (b - hz) / (b - c)))


def log_mels(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Logarithms of the mel bands, a row for each whole frame."""
    frames = np.lib.stride_tricks.sliding_window_view(x, FFT)[::HOP]
    return np.log(np.maximum(np.abs(np.fft.rfft(frames * np.hanning(FFT), axis=1)) @ filters.T, 1e-5))


def mel_frames(blocks: DataFrame, size: int) -> DataFrame:
    """(recording_id, frame_idx, mel, log_energy) of blocks with FFT samples after them: spectra in Arrow batches, a frame in the block where it begins."""
    filters = mel_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = zip(*(batch.column(c).to_pylist() for c in (KEY, "n", "block", "start")), rows_of(batch.column("samples")), strict=True)
            for rid, n, block, start, x in heads:
                first, last = -(-block * size // HOP), min(((block + 1) * size - 1) // HOP, (n - FFT) // HOP)
                if last < first:
                    continue
                e = log_mels(x[first * HOP - start : last * HOP - start + FFT], filters)
                f, m = np.divmod(np.arange(e.size), MELS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(e.size, rid)), pa.array(first + f), pa.array(m), pa.array(e.ravel())], [KEY, "frame_idx", "mel", "log_energy"])

    return blocks.mapInArrow(run, "recording_id long, frame_idx long, mel long, log_energy double")


def pooled_blocks(blocks: DataFrame) -> DataFrame:
    """(recording_id, i, v): the statistics, as `pooled_rows` has them, of recordings of one block, where the block is."""
    filters = mel_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.concatenate([e.mean(axis=0), e.std(axis=0), *np.percentile(e, [25, 75], axis=0)]) for e in (log_mels(x, filters) for x in rows_of(batch.column("samples")))]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), lists([np.arange(MELS * len(STATS))] * len(out)).cast(pa.list_(pa.int64())), lists(out)], [KEY, "i", "v"])

    return blocks.select(KEY, "samples").mapInArrow(run, "recording_id long, i array<long>, v array<double>")


def pooled_rows(mels: DataFrame, bands: int = MELS) -> DataFrame:
    """(recording_id, i, value): the statistics of all bands one after another."""
    rows = spectra.stat_pooling(mels)
    parts = [rows.select(KEY, (F.col("mel") + k * bands).alias("i"), F.col(s).alias("value")) for k, s in enumerate(STATS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def project(pooled: DataFrame, matrix: DataFrame) -> DataFrame:
    """(recording_id, j, value): the product with the matrix, at length one; equal values where the product has no length.

    The matrix is a table of fixed size; a recording's values meet in one row and are multiplied in Arrow batches.
    """
    rows = pooled.groupBy(KEY).agg(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value"))).alias("s"))
    return _products(rows.select(KEY, F.col("s.i").alias("i"), F.col("s.value").alias("v")), matrix)


def _products(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """The product of rows (recording_id, i, v), lists of places and values, with the matrix."""
    i, j, w = (matrix.toArrow().column(c).to_numpy() for c in ("i", "j", "w"))
    dense = np.zeros((i.max() + 1, j.max() + 1))
    dense[i, j] = w
    kind = dict(rows.dtypes)[KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = np.zeros((part.num_rows, len(dense)))
                for k, (at, v) in enumerate(zip(rows_of(part.column("i")), rows_of(part.column("v")), strict=True)):
                    x[k, at] = v
                y = x @ dense
                length = np.sqrt((y * y).sum(axis=1, keepdims=True))
                y = np.where(length > 1e-8, y / np.maximum(length, 1e-8), 1 / math.sqrt(dense.shape[1]))
                ids = part.column(KEY).take(pa.array(np.repeat(np.arange(len(y)), y.shape[1])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(y.shape[1]), len(y))), pa.array(y.ravel())], [KEY, "j", "value"])

    return rows.mapInArrow(run, f"{KEY} {kind}, j long, value double")


def voice_embeddings(blocks: DataFrame, size: int, least: int = 1024) -> DataFrame:
    """(recording_id, j, value) of each recording in blocks with FFT samples after them; recordings under `least` samples have equal values."""
    matrix = seeded_matrix(blocks.sparkSession)
    long = project(pooled_rows(mel_frames(blocks.where((F.col("n") >= least) & (F.col("n") > size)), size)), matrix)
    long = long.unionByName(_products(pooled_blocks(blocks.where((F.col("n") >= least) & (F.col("n") <= size))), matrix))
    equal = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DIM - 1).cast("long")))
    short = blocks.where((F.col("n") < least) & (F.col("block") == 0)).select(KEY, equal.alias("j"), F.lit(1 / math.sqrt(DIM)).alias("value"))
    return long.unionByName(short)
