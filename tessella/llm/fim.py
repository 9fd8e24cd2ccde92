"""Fill-in-middle transformation with a sparse checkpoint index.

A text is cut into units, its lines with their line ends. One counting pass over its UTF-8 bytes, in blocks, records the byte and
code-point offset of every EVERY-th unit; nothing is kept for the units between. A cut then searches the checkpoints and reads on
from the one before it, at most EVERY units, to its own offsets. Two cuts, drawn from the SHA-256 of seed and doc_id, part a text
into prefix, middle and suffix, which are laid out with sentinels; `restored` rebuilds the text from that alone.

Each text is handled in one row of one task with no shuffle; besides the text and its output a task holds the checkpoints.

Defined results: a null text counts as empty; empty texts and texts that hold a sentinel stay as they are (form plain); a null doc_id
draws as an empty string. Texts of one line, or cuts that meet, leave parts empty. Repeated rows give repeated results, extra columns
are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
#: Percent of texts that are transformed, and of these the percent whose suffix comes first.
RATE, SPM = 100, 50
#: Units from one checkpoint to the next.
EVERY = 64
#: Bytes that the counting pass looks at at once.
BLOCK = 1 << 16

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Checkpoints:
    """Byte and code-point offsets of every `every`-th line of a text."""

    def __init__(self, raw: bytes, every: int = EVERY, block: int = BLOCK) -> None:
        self.raw, self.every = raw, every
        self.units, self.byte, self.char = [0], [0], [0]
        units = chars = 0
        data = np.frombuffer(raw, np.uint8)
        for start in range(0, len(raw), block):
            part = data[start : start + block]
            leads = (part & 0xC0) != 0x80  # continuation bytes start no code point
            ends = np.flatnonzero(part == 10)
            # the k-th line end of this block ends unit units + k + 1
            marked = ends[every - 1 - units % every :: every]
            if len(marked):
                upto = np.cumsum(leads)[marked] + chars
                first = units - units % every + every
                self.units += range(first, first + every * len(marked), every)
                self.byte += (marked + start + 1).tolist()
                self.char += upto.tolist()
            units += len(ends)
            chars += int(np.count_nonzero(leads))
        self.n = units + (bool(raw) and raw[-1] != 10)
        self.chars = chars

    def at(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which a unit begins; the text's ends for a unit past its last."""
        if unit >= self.n:
            return len(self.raw), self.chars
        k = bisect_right(self.units, unit) - 1
        begin = end = self.byte[k]
        for _ in range(unit - self.units[k]):
            end = self.raw.index(b"\n", end) + 1
        return end, self.char[k] + code_points(self.raw[begin:end])


def code_points(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def cut(raw: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> Cut:
    """One text's layout."""
    index = Checkpoints(raw)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
    if not raw or PREFIX in raw or SUFFIX in raw or MIDDLE in raw or h3 % 100 >= rate:
        return Cut(index.n, "plain", None, None, raw)
    low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, a_chars), (b, b_chars) = index.at(low), index.at(high)
    if h4 % 100 < spm:
        form, parts = "spm", (SUFFIX, raw[b:], PREFIX, raw[:a], MIDDLE, raw[a:b])
    else:
        form, parts = "psm", (PREFIX, raw[:a], SUFFIX, raw[b:], MIDDLE, raw[a:b])
    return Cut(index.n, form, a_chars, b_chars - a_chars, b"".join(parts))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """A row for each document: doc_id, lines, form, code points of prefix and middle, and the training text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                ids = batch.column("doc_id").slice(start, len(texts))
                rows = [cut(raw, i, seed, rate, spm) for raw, i in zip(texts.cast(pa.binary()).to_pylist(), ids.to_pylist(), strict=True)]
                n, form, prefix, middle, out = zip(*rows, strict=True)
                longs = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
                yield pa.RecordBatch.from_arrays([ids, longs[0], pa.array(form), *longs[1:], pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text, from a training text and its form alone: sentinels occur once each, as texts that hold one stay plain."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substring_index(output, m, -1)
    before = F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(before, s, 1), p, -1), middle, F.substring_index(before, s, -1))
    spm = F.concat(F.substring_index(before, p, -1), middle, F.substring_index(F.substring_index(before, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """Digests of each training text and of the text rebuilt from it."""
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    out = transform(docs)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
