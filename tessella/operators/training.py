"""Training of the residual network and of its calibration, with sums that Spark gathers.

A step sends the parameters to all tasks, each adds up loss and gradient over its rows, and Spark sums these by parameter before they reach
the driver: as many numbers as the network has, however many rows and tasks there are. Rows are split by their source, so copies of one
recording never fall on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import erf

Parameters = dict[str, np.ndarray]
#: Rows that are taken at once: what the way back needs of them stays in a core's cache.
SLICE = 512


def new_network(inputs: int = 60, hidden: int = 128, blocks: int = 3, mid: int = 64, seed: int = 0) -> Parameters:
    """Weights drawn evenly within one over the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    out: Parameters = {}

    def layer(name: str, a: int, b: int, norm: bool = True) -> None:
        reach = 1 / math.sqrt(a)
        out[f"{name}.weight"], out[f"{name}.bias"] = rng.uniform(-reach, reach, (b, a)), rng.uniform(-reach, reach, b)
        if norm:
            out[f"{name}.scale"], out[f"{name}.shift"] = np.ones(b), np.zeros(b)

    layer("in", inputs, hidden)
    for k in range(blocks):
        layer(f"block{k}.a", hidden, hidden)
        layer(f"block{k}.b", hidden, hidden)
    layer("mid", hidden, mid)
    layer("out", mid, 1, norm=False)
    return out


def _unit(p: Parameters, name: str, v: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Linear layer, layer normalisation and GELU; with what the way back needs."""
    z = v @ p[f"{name}.weight"].T + p[f"{name}.bias"]
    s = np.sqrt(z.var(axis=1, keepdims=True) + 1e-5)
    n = (z - z.mean(axis=1, keepdims=True)) / s
    y = n * p[f"{name}.scale"] + p[f"{name}.shift"]
    below = 0.5 * (1 + erf(y / math.sqrt(2)))
    return y * below, (name, v, s, n, y, below)


def _back(p: Parameters, held: tuple, d: np.ndarray, out: Parameters) -> np.ndarray:
    """Adds a unit's gradients to `out`; the gradient of its input."""
    name, v, s, n, y, below = held
    dy = d * (below + y * np.exp(-0.5 * y * y) / math.sqrt(2 * math.pi))
    out[f"{name}.scale"], out[f"{name}.shift"] = (dy * n).sum(axis=0), dy.sum(axis=0)
    dn = dy * p[f"{name}.scale"]
    dz = (dn - dn.mean(axis=1, keepdims=True) - n * (dn * n).mean(axis=1, keepdims=True)) / s
    out[f"{name}.weight"], out[f"{name}.bias"] = dz.T @ v, dz.sum(axis=0)
    return dz @ p[f"{name}.weight"]


def forward(p: Parameters, x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Logits of rows, and what the way back needs."""
    h, held = _unit(p, "in", x)
    units = [held]
    k = 0
    while f"block{k}.a.weight" in p:
        a, first = _unit(p, f"block{k}.a", h)
        b, second = _unit(p, f"block{k}.b", a)
        h = h + b
        units += [first, second]
        k += 1
    m, held = _unit(p, "mid", h)
    units += [held, ("out", m)]
    return m @ p["out.weight"][0] + p["out.bias"][0], units


def loss_and_gradient(p: Parameters, x: np.ndarray, label: np.ndarray) -> tuple[float, int, Parameters]:
    """Sums of the cross-entropy, of right decisions, and of gradients over rows."""
    logit, units = forward(p, x)
    loss = np.logaddexp(0, logit) - label * logit
    d = 1 / (1 + np.exp(-np.clip(logit, -500, 500))) - label
    out: Parameters = {"out.weight": (d @ units[-1][1])[None], "out.bias": np.array([d.sum()])}
    back = _back(p, units[-2], d[:, None] * p["out.weight"], out)
    for k in range(len(units) // 2 - 2, -1, -1):
        back = back + _back(p, units[2 * k + 1], _back(p, units[2 * k + 2], back, out), out)
    _back(p, units[0], back, out)
    return float(loss.sum()), int(((logit >= 0) == (label >= 0.5)).sum()), out


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(v: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("features")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), batch.column("label").to_numpy(zero_copy_only=False).astype(float)


def sums(rows: DataFrame, p: Parameters, gradient: bool = True) -> tuple[float, int, int, np.ndarray | None]:
    """(loss, right, rows, gradient) over (features, label)."""
    sent = rows.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, right, n, total = 0.0, 0, 0, None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                x, label = _rows(batch.slice(start, SLICE))
                part = loss_and_gradient(sent.value, x, label)
                loss, right, n = loss + part[0], right + part[1], n + len(label)
                if gradient:
                    total = flat(part[2]) + (0 if total is None else total)
        if n:
            values = [loss, right, n, *([] if total is None else total)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], ["pos", "value"])

    got = rows.select("features", "label").mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).toArrow()
    sent.unpersist()
    value = np.zeros(3 + (flat(p).size if gradient else 0))
    value[got.column("pos").to_numpy()] = got.column("value").to_numpy()
    return float(value[0]), int(value[1]), int(value[2]), value[3:] if gradient else None


class Fit(NamedTuple):
    parameters: Parameters
    history: list[dict[str, float]]


def held_out(source: Column, share: int = 4) -> Column:
    """Whether rows of a source are for validation: one source in `share`."""
    return F.pmod(F.xxhash64(source), F.lit(share)) == 0


def train(rows: DataFrame, start: Parameters, epochs: int = 25, rate: float = 1e-3, decay: float = 1e-4, batches: int = 1) -> Fit:
    """Fit to rows (source, features, label): AdamW with a cosine rate, the parameters of least validation loss kept.

    A batch holds the sources that a hash of source and epoch deals to it. The history has a row for each epoch.
    """
    learn, check = rows.where(~held_out(F.col("source"))), rows.where(held_out(F.col("source")))
    v = flat(start)
    first, second, step = np.zeros_like(v), np.zeros_like(v), 0
    best, least, history = start, math.inf, []
    for epoch in range(epochs):
        pace = rate * (1 + math.cos(math.pi * epoch / epochs)) / 2
        loss = n = 0
        for k in range(batches):
            own = learn if batches == 1 else learn.where(F.pmod(F.xxhash64("source", F.lit(epoch)), F.lit(batches)) == k)
            l, _, m, g = sums(own, shaped(v, start))
            if not m:
                continue
            loss, n, step = loss + l, n + m, step + 1
            g = g / m
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            v = v * (1 - pace * decay) - pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        seen = shaped(v, start)
        l, right, m, _ = sums(check, seen, gradient=False)
        if m and l / m < least:
            best, least = seen, l / m
        history.append({"epoch": epoch + 1, "train_loss": loss / max(n, 1), "val_loss": l / max(m, 1), "val_accuracy": right / max(m, 1), "n_train": n, "n_val": m})
    return Fit(best if least < math.inf else shaped(v, start), history)


def predict(rows: DataFrame, p: Parameters, keep: str = "recording_id") -> DataFrame:
    """(keep, logit, probability) of rows (keep, features); parameters go to all tasks, so they are of a checked size where they are loaded."""
    sent = rows.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features")
            logit, _ = forward(sent.value, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(logit), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], [keep, "logit", "probability"])

    return rows.select(F.col(keep).cast("long").alias(keep), "features").mapInArrow(run, f"{keep} long, logit double, probability double")


def fit_platt(rows: DataFrame, penalty: float = 1.0, steps: int = 25) -> tuple[float, float]:
    """Slope and offset of 1 / (1 + exp(-(a s + b))) on (score, label), by Newton steps whose five sums Spark gathers; the slope is penalised by half its square."""
    a = b = 0.0
    s, y = F.col("score"), F.col("label").cast("double")
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(a * s + b)))
        w = p * (1 - p)
        g_b, g_a, h_bb, h_ab, h_aa = (x or 0.0 for x in rows.agg(F.sum(p - y), F.sum((p - y) * s), F.sum(w), F.sum(w * s), F.sum(w * s * s)).first())
        g_a, h_aa = g_a + penalty * a, h_aa + penalty
        det = h_aa * h_bb - h_ab * h_ab
        if det <= 1e-12:
            break
        d_a, d_b = (h_bb * g_a - h_ab * g_b) / det, (h_aa * g_b - h_ab * g_a) / det
        a, b = a - d_a, b - d_b
        if abs(d_a) + abs(d_b) < 1e-12:
            break
    return a, b


def usable_platt(a: float, b: float) -> tuple[float, float]:
    """What is kept of a fit: a slope from 8 to 18, else the default."""
    return (a, b) if 8.0 <= a <= 18.0 else (10.0, -5.0)
