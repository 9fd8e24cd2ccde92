"""Voice activity of one window of samples, as tasks call it on windows of a stream or chunks of a recording."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import kernels

#: Frame of 30 ms and half of it as step, speech band, pitch range, levels in dB.
FRAME_MS, BAND, PITCH, QUIET_DB, LEAST_DB, SHORT_DB = 30, (140.0, 3800.0), (75.0, 420.0), -52.0, -55.0, -42.0
#: Frames of silence that are bridged, and of speech that are needed.
BRIDGED, BURST = 16, 6
#: Frames of a held note, and how far its pitch may move.
HELD, TOLERANCE = 24, 0.04


@lru_cache(maxsize=16)
def _system(rate: int):
    from ..operators.recurrence import Runner, cascade

    return Runner(cascade(kernels.butterworth(4, 85.0, rate, "high")))


def runs(flags: np.ndarray) -> list[tuple[int, int, bool]]:
    """(first, end, flag) of equal neighbours."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8))) + 1
    ends = [0, *edges.tolist(), len(flags)]
    return [(a, b, bool(flags[a])) for a, b in zip(ends, ends[1:], strict=False)] if len(flags) else []


def smooth(flags: np.ndarray, bridged: int = BRIDGED, burst: int = BURST) -> np.ndarray:
    """Gaps of at most `bridged` frames between speech are filled, then bursts under `burst` frames dropped."""
    out = flags.copy()
    spans = runs(flags)
    for a, b, on in spans[1:-1]:
        if not on and b - a <= bridged:
            out[a:b] = True
    for a, b, on in runs(out):
        if on and b - a < burst:
            out[a:b] = False
    return out


def held_notes(pitches: np.ndarray, least: int = HELD, tolerance: float = TOLERANCE) -> tuple[int, int]:
    """(distinct pitches, frames) of notes held for `least` frames; a note goes on while the pitch stays near its first."""
    notes: list[float] = []
    held = hold = 0
    first = 0.0
    for p in [*pitches.tolist(), 0.0]:
        if p > 0 and first > 0 and abs(p - first) / first < tolerance:
            hold += 1
            continue
        if hold >= least:
            held += hold
            if not any(abs(first - n) / n < tolerance for n in notes):
                notes.append(first)
        first, hold = max(p, 0.0), int(p > 0)
    return len(notes), held


def frame_flags(x: np.ndarray, rate: int) -> np.ndarray | None:
    """Speech or not for each frame before smoothing; None where the window as a whole is no speech."""
    size = int(rate * FRAME_MS / 1000)
    y, _ = _system(rate).run(x, np.zeros(4))
    f = kernels.frames_of(y, size, size // 2)
    db = 20 * np.log10(np.sqrt((f * f).mean(axis=1) + 1e-12))
    floor = np.percentile(db, 15)
    least = min(max(-48.0, floor + 5) if floor < -35 else -48.0, db.max() - 2)
    zcr = np.abs(np.diff(np.sign(f), axis=1)).mean(axis=1) / 2
    w = f * np.hanning(size)
    power = np.abs(np.fft.rfft(w, axis=1)) ** 2
    hz = np.fft.rfftfreq(size, 1 / rate)
    band = power[:, (hz >= BAND[0]) & (hz <= BAND[1])].sum(axis=1) / (power.sum(axis=1) + 1e-12)
    r = np.fft.irfft(np.abs(np.fft.rfft(w, 1 << (2 * size - 1).bit_length(), axis=1)) ** 2, axis=1)
    low, high = max(1, int(rate / PITCH[1])), min(size - 1, int(rate / PITCH[0]))
    lag = low + np.argmax(r[:, low:high], axis=1)
    strength = r[np.arange(len(r)), lag] / (r[:, 0] + 1e-12)
    loud = (db >= least) & (db >= QUIET_DB)
    voiced = loud & (strength >= 0.30) & (rate / lag >= PITCH[0]) & (rate / lag <= PITCH[1]) & (band >= 0.20)
    noisy = loud & (zcr >= 0.12) & (band >= 0.16)
    flags = voiced | noisy
    if len(f) >= 20:
        n = len(f)
        if voiced.sum() < max(2, int(0.02 * n)) and flags.sum() < max(3, int(0.03 * n)):
            return None
        if not noisy.any() and voiced.any() and strength[voiced].mean() < 0.45 and zcr.max() < 0.10:
            return None
        energy = 10 ** (db / 20)
        if (energy < 0.35 * energy.mean()).mean() < 0.08 and (zcr > 0.12).mean() < 0.03:
            notes, held = held_notes((rate / lag)[voiced])
            if notes >= 3 and held >= 0.30 * n:
                return None
    return flags


def segments(x: np.ndarray, rate: int) -> list[tuple[int, int, bool]]:
    """(first sample, end, speech) of a window: frames in a row; all but the last segment reach to their last frame's end."""
    n = len(x)
    if not n:
        return []
    level = 20 * np.log10(np.sqrt((x * x).mean() + 1e-12))
    size = int(rate * FRAME_MS / 1000)
    if np.abs(x).max() < 1e-4 or level < LEAST_DB:
        return [(0, n, False)]
    if n >= rate // 2:
        part = x[: 3 * rate]
        power = np.abs(np.fft.rfft(part * np.hanning(len(part)))) ** 2
        hz = np.fft.rfftfreq(len(part), 1 / rate)
        total = power.sum() + 1e-12
        if power[hz < 85].sum() / total > 0.40 and power[(hz >= BAND[0]) & (hz <= BAND[1])].sum() / total < 0.30:
            return [(0, n, False)]
    if n < size:
        return [(0, n, bool(level > SHORT_DB))]
    flags = frame_flags(x, rate)
    if flags is None:
        return [(0, n, False)]
    spans = runs(smooth(flags))
    hop = size // 2
    return [(a * hop, n if k == len(spans) - 1 else min(n, (b - 1) * hop + size), on) for k, (a, b, on) in enumerate(spans)]


def speech_share(x: np.ndarray, rate: int) -> float:
    """Share of a window that lies in speech segments, at most 1."""
    return min(1.0, sum(b - a for a, b, on in segments(x, rate) if on) / len(x)) if len(x) else 0.0
