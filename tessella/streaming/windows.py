"""Streams of packets: hopping windows over a session's samples, with keyed state, and windowed levels with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.activity import speech_share
from ..functions.resample import polyphase
from ..operators import whole
from ..plans import scoring
from .packets import samples_of

WINDOWS = "session_id string, window_no long, start_idx long, n int, mean double, peak double, rms double, speech_ratio double, received_ms double"
STATE = "held array<double>, next long, rate int, last long"
#: Windows that are held until they are measured together.
MEASURED = 32


def speech_ratio(window: np.ndarray, frame: int, least_db: float) -> float:
    """Share of the window's whole frames that are louder than `least_db`; 0 without one."""
    whole = window[: len(window) // frame * frame].reshape(-1, frame)
    return float((20 * np.log10(np.maximum(np.sqrt((whole * whole).mean(1)), 1e-7)) > least_db).mean()) if len(whole) else 0.0


def may_pass(peak: float, rms: float, ratio: float) -> bool:
    """Whether `scoring.stream_gate` can pass a window; what lies at its levels' very bounds is left to it."""
    return ratio > 0.0999 and peak > 0.0149 and rms > 10 ** (-50.01 / 20)


def hopping_windows(
    packets: DataFrame, size: int, hop: int, target_rate: int | None = None, frame: int = 320, least_db: float = -48.0, idle_minutes: int | None = None, voice: bool = False, keep: bool = False, measure: list[str] | None = None
) -> DataFrame:
    """Windows of `size` samples each `hop` samples, of packets (session_id, seq, sample_rate, samples), with level and speech ratio.

    A session's state is the samples that a later window still needs, fewer than size + a packet, whatever the stream's length; it is
    dropped after `idle_minutes` without a packet, if given (such a query goes on until it is stopped). A change of rate drops held samples and goes on counting; a packet with a true
    `reset` column starts the session anew. One with a true `end` column is the session's last: its state is dropped with the batch, so finished sessions hold nothing. No tail is emitted. Packets of one batch are taken by seq, and one whose seq is not above
    that of the packet before it, in this batch or an earlier one, is left out; a reset lets any seq follow. A packet without samples only brings its rate or reset. NaN and infinite samples become 0. With `target_rate`, each window is resampled to it
    before it is measured. The speech ratio is the share of frames over `least_db`, or with `voice` that of the window's speech segments. `received_ms` is that column of the packet that completed the window, if there is one. `keep` adds the window's samples, for what is to be found in them.
    Packets may come as (payload, encoding) in place of samples, so that they take no more room than what was sent. `measure` names features that are worked out of a window where it is cut, as `v`,
    not rounded; null for a window that would not pass the gate. So windows leave their task as a few numbers, not with their samples.
    """
    schema = WINDOWS + ", samples array<double>" * keep + ", v array<double>" * (measure is not None)
    encoded = "payload" in packets.columns
    names = [c.split()[0] for c in schema.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, start, rate, last = state.get if state.exists else ([], 0, 0, -1)
        held = np.array(held, float)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        out, ended, waiting = [], False, []

        def fill() -> None:
            """Features of the windows that wait for them."""
            found = whole.measured([w for _, w in waiting], measure)[1]
            for (k, _), v in zip(waiting, found, strict=True):
                out[k] = (*out[k][:-1], v.tolist())
            waiting.clear()

        for row in rows.to_dict("records"):
            ended = bool(row.get("end"))
            if row.get("reset"):
                held, start = held[:0], 0
            elif row["seq"] <= last:
                continue
            last = row["seq"]
            if rate and row["sample_rate"] != rate:
                held = held[:0]
            rate, samples = int(row["sample_rate"]), samples_of(row["payload"], row["encoding"]) if encoded else row["samples"]
            new = np.zeros(0) if samples is None else samples if encoded else np.array([0.0 if v is None else v for v in samples], float)
            held = np.concatenate([held, np.where(np.isfinite(new), new, 0.0)])
            while len(held) >= size:
                w = polyphase(held[:size], rate, target_rate) if target_rate and target_rate != rate else held[:size]
                peak, rms, ratio = np.abs(w).max(), np.sqrt((w * w).mean()), speech_share(w, target_rate or rate) if voice else speech_ratio(w, frame, least_db)
                out.append((key[0], start // hop, start, len(w), w.mean(), peak, rms, ratio, row.get("received_ms"), *([w.tolist()] if keep else []), *([None] if measure is not None else [])))
                if measure is not None and may_pass(peak, rms, ratio):
                    waiting.append((len(out) - 1, w))
                    if len(waiting) == MEASURED:
                        fill()
                held, start = held[hop:], start + hop
        if waiting:
            fill()
        if not ended:
            state.update((held.tolist(), int(start), rate, int(last)))
            if idle_minutes:
                state.setTimeoutDuration(idle_minutes * 60_000)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names).astype({"received_ms": float})

    return packets.groupBy("session_id").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_minutes else GroupStateTimeout.NoTimeout)


def fast_lane(windows: DataFrame, raw: Column) -> DataFrame:
    """gate, probability, category and verdict of each emitted window, from its own raw score; what does not pass the gate scores 0. No alert is sent."""
    db = F.when(F.col("rms") <= 1e-7, -100.0).otherwise(20 * F.log10("rms"))
    got = windows.withColumn("gate", scoring.stream_gate(F.col("speech_ratio") > 0, F.col("peak"), F.col("speech_ratio"), db))
    got = got.withColumn("probability", F.when(F.col("gate") == "pass", F.round(scoring.calibrate(raw), 4)).otherwise(0.0))
    p = F.col("probability")
    verdict = F.when(F.col("gate") != "pass", "NO_SPEECH").when(p >= 0.75, "SYNTHETIC").when(p >= 0.45, "UNCERTAIN").otherwise("REAL")
    return got.withColumn("category", scoring.category(p)).withColumn("verdict", verdict)


def with_latency(windows: DataFrame) -> DataFrame:
    """Milliseconds from the receipt of the packet that completed a window to now."""
    now = F.unix_micros(F.current_timestamp()) / 1000.0
    return windows.withColumn("latency_ms", F.when(F.col("received_ms").isNotNull() & ~F.isnan("received_ms"), F.greatest(now - F.col("received_ms"), F.lit(0.0))))


def gated(windows: DataFrame, least_peak: float = 0.015, least_db: float = -50.0) -> DataFrame:
    """Windows with their level and whether they are loud enough to be scored."""
    db = F.when(F.col("rms") <= 1e-7, -100.0).otherwise(20 * F.log10("rms"))
    return windows.withColumn("rms_db", db).withColumn("scored", (F.col("peak") >= least_peak) & (db > least_db))


def levels_by_time(events: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count and mean value by type and tumbling window of event time; rows later than the watermark are left out of a stream.

    Works on a stream and on a table alike; `ts` is read as UTC.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    got = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return got.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "mean_value")
