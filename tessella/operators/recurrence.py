"""Recursive filters over recordings in blocks.

A cascade of second-order sections is a linear system with a small state. Over a block the state at its end is a matrix power times the state at its
start, plus what the block adds from rest. So each block first computes what it adds, a recording's blocks are composed in order (a short vector
each), and then every block runs from its own true start. Results equal the filter that runs through from the first sample, at any block size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import KEY, lists, rows_of, runs

#: Samples that are advanced at once.
CHUNK = 64


class LinearSystem(NamedTuple):
    """y = c s + d x and s' = a s + b x."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float


def cascade(sections: list[tuple[np.ndarray, np.ndarray]]) -> LinearSystem:
    """Sections (b, a) of order two at most, one after another, as one system."""
    out = LinearSystem(np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0)
    for b, a in sections:
        b, a = np.pad(b, (0, 3 - len(b))) / a[0], np.pad(a, (0, 3 - len(a))) / a[0]
        own = LinearSystem(np.array([[-a[1], 1.0], [-a[2], 0.0]]), b[1:] - a[1:] * b[0], np.array([1.0, 0.0]), float(b[0]))
        n = len(out.b)
        joint = np.zeros((n + 2, n + 2))
        joint[:n, :n], joint[n:, n:], joint[n:, :n] = out.a, own.a, np.outer(own.b, out.c)
        out = LinearSystem(joint, np.concatenate([out.b, own.b * out.d]), np.concatenate([own.d * out.c, own.c]), own.d * out.d)
    return out


class Runner:
    """Runs a system over samples, a chunk at a time."""

    def __init__(self, system: LinearSystem, chunk: int = CHUNK) -> None:
        self.system, self.chunk = system, chunk
        powers = [np.eye(len(system.b))]
        for _ in range(chunk):
            powers.append(powers[-1] @ system.a)
        self.powers = np.array(powers)
        impulse = np.concatenate([[system.d], self.powers[: chunk - 1] @ system.b @ system.c])
        lag = np.arange(chunk)[None, :] - np.arange(chunk)[:, None]
        self.inner = np.where(lag >= 0, impulse[np.clip(lag, 0, chunk - 1)], 0.0)  # input j to output i
        self.seen = self.powers[:chunk].transpose(0, 2, 1) @ system.c  # state to output i
        self.fed = (self.powers[:chunk] @ system.b)[::-1]  # input j to the state after the chunk

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output, and the state after the last sample."""
        whole = len(x) // self.chunk
        parts = np.append(x, np.zeros(-len(x) % self.chunk)).reshape(-1, self.chunk)
        gains, step = parts @ self.fed, self.powers[-1]
        states = np.empty((len(parts), len(state)))
        for k in range(len(parts)):
            states[k] = state
            if k < whole:
                state = step @ state + gains[k]
        rest = x[whole * self.chunk :]
        if len(rest):
            state = self.powers[len(rest)] @ state + rest @ self.fed[self.chunk - len(rest) :]
        return (parts @ self.inner + states @ self.seen.T).ravel()[: len(x)], state

    def run_all(self, parts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Output of many signals at once: rows of a chunk's length, each with its place within its signal, which starts from rest. States are composed by doubling."""
        states, step, reach = parts @ self.fed, self.powers[-1], 1
        while reach <= place.max(initial=0) and np.abs(step).max() > 1e-40:  # what is smaller adds nothing
            own = np.flatnonzero(place >= reach)
            states[own] += states[own - reach] @ step.T
            step, reach = step @ step, 2 * reach
        before = np.zeros_like(states)
        own = np.flatnonzero(place > 0)
        before[own] = states[own - 1]
        return parts @ self.inner + before @ self.seen.T


def block_starts(blocks: DataFrame, sections: list[tuple[np.ndarray, np.ndarray]], size: int) -> DataFrame:
    """(recording_id, block, state) of every block but the first ones of recordings, whose state is zero."""
    runner = Runner(cascade(sections))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x[b * size - s :][:size] for x, b, s in zip(rows_of(batch.column("samples")), batch.column("block").to_pylist(), batch.column("start").to_pylist(), strict=True)]
            state = [runner.run(x, np.zeros(len(runner.system.b)))[1] for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("block"), lists(state)], [KEY, "block", "state"])

    whole = np.linalg.matrix_power(runner.system.a, size)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, np.zeros(0)
        for key, part in runs(batches, [KEY]):
            if key != last:
                last, state = key, np.zeros(len(runner.system.b))
            out = []
            for added in rows_of(part.column("state")):
                state = whole @ state + added
                out.append(state)
            following = pa.array(part.column("block").to_numpy() + 1)
            yield pa.RecordBatch.from_arrays([part.column(KEY), following, lists(out)], [KEY, "block", "state"])

    # the last block of a recording has no successor
    added = blocks.where((F.col("block") + 1) * size < F.col("n")).select(KEY, "block", "start", "samples").mapInArrow(ends, "recording_id long, block long, state array<double>")
    return added.repartition(KEY).sortWithinPartitions(KEY, "block").mapInArrow(compose, "recording_id long, block long, state array<double>")


def with_starts(blocks: DataFrame, sections: list[tuple[np.ndarray, np.ndarray]], size: int) -> DataFrame:
    """The blocks with the filter's state before their first own sample; first blocks are not shuffled, they begin from rest."""
    zero = F.array(*[F.lit(0.0)] * (2 * len(sections)))
    later = blocks.where("block > 0").join(block_starts(blocks, sections, size), [KEY, "block"], "left")
    return blocks.where("block = 0").withColumn("state", zero).unionByName(later.withColumn("state", F.coalesce("state", zero)))


def filtered(blocks: DataFrame, sections: list[tuple[np.ndarray, np.ndarray]], size: int) -> DataFrame:
    """(recording_id, block, n, start, samples): the blocks' own samples after the filter, without halo."""
    runner = Runner(cascade(sections))
    names = [KEY, "block", "n", "start", "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, start = batch.column("block").to_numpy(), batch.column("start").to_numpy()
            out = [runner.run(x[b * size - s :][:size], state)[0] for x, state, b, s in zip(rows_of(batch.column("samples")), rows_of(batch.column("state")), block, start, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("block"), batch.column("n"), pa.array(block * size), lists(out)], names)

    return with_starts(blocks, sections, size).select(*names, "state").mapInArrow(run, "recording_id long, block long, n long, start long, samples array<double>")


def remove_dc(samples: DataFrame, sections: list[tuple[np.ndarray, np.ndarray]], size: int, least: int = 64) -> DataFrame:
    """(recording_id, idx, x): each recording less its mean, then high-passed if it has more than `least` samples."""
    from .blocks import sample_blocks
    from .levels import remove_dc as centred

    blocks = sample_blocks(centred(samples).select(KEY, "idx", "x"), size)
    passed = filtered(blocks.where(F.col("n") > least), sections, size).unionByName(blocks.where(F.col("n") <= least))
    return passed.select(KEY, (F.col("start")).alias("start"), F.posexplode("samples").alias("pos", "x")).select(KEY, (F.col("start") + F.col("pos")).alias("idx"), "x")
