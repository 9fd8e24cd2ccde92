"""Helpers that the training-data operators share.

Texts are handled in Arrow batches: a batch is cut into slices of bounded bytes, and each
slice is split into words and dictionary-encoded in C, so that the work per token is numpy work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a default only where none is set and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


#: Lists that collect the folders which `materialize` writes; the innermost `written` gets them.
_WRITTEN: list[list[str]] = []


@contextmanager
def written() -> Iterator[list[str]]:
    """Collects the folders that are written meanwhile, for `remove` once nothing reads them."""
    paths: list[str] = []
    _WRITTEN.append(paths)
    try:
        yield paths
    finally:
        _WRITTEN.remove(paths)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders of the shared folder."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, label: str) -> DataFrame:
    """`materialize` in buckets of a column, so that joins on it do not shuffle these rows. The table's name is dropped at once, its files stay."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    writer = df.write.option("compression", "zstd").option("path", path)
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(name)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of a string array; null counts as empty; slices hold about `limit` bytes."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array laid end to end, and the offsets (one more than rows)."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: `ids` index `vocab`; row r owns ids[offsets[r]:offsets[r + 1]]."""

    ids: np.ndarray
    vocab: pa.Array
    offsets: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text; lower folds A-Z only."""
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    bounds = parts.offsets.to_numpy().astype(np.int64)
    values = parts.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    coded = values.dictionary_encode()
    ids, vocab = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    blank = pc.index(vocab, "").as_py()
    if blank >= 0:  # leading and trailing white space leaves empty parts
        full = ids != blank
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        ids = ids[full]
    return Words(ids, vocab, bounds)


def vocab_hashes(vocab: pa.Array) -> np.ndarray:
    """XXH64 of each distinct word."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab.to_pylist()), np.uint64, len(vocab))


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's run of values; empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
