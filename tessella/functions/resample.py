"""Polyphase resampling with a zero-phase low-pass."""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np


@lru_cache(maxsize=32)
def filter_taps(up: int, down: int) -> np.ndarray:
    """Windowed sinc (Kaiser, 5.0) of ten zero crossings each way, cut at the lower of both rates; its gain makes up for the zeros between samples."""
    most = max(up, down)
    half = 10 * most
    h = np.sinc(np.arange(-half, half + 1) / most) * np.kaiser(2 * half + 1, 5.0)
    return h / h.sum() * up


def reach(source: int, target: int) -> int:
    """Samples on either side of a place that an output there depends on."""
    g = gcd(source, target)
    return 10 * max(source, target) // target + 2 if g else 0


def polyphase(x: np.ndarray, source: int, target: int, first: int = 0, end: int | None = None, base: int = 0, n: int | None = None) -> np.ndarray:
    """Outputs first to end - 1 of a recording of n samples at the target rate; x holds its samples from `base` on, as far as these outputs need them."""
    n = base + len(x) if n is None else n
    g = gcd(source, target)
    up, down = target // g, source // g
    end = -(-n * up // down) if end is None else end
    if up == down:
        return x[first - base : end - base].astype(float)
    h = filter_taps(up, down)
    half = len(h) // 2
    width = 2 * half // up + 1
    start_of = lambda k: -(-(k * down - half) // up)  # noqa: E731  the first sample that output k depends on
    low = start_of(first)
    wide = np.zeros(max(0, start_of(end - 1) + width - low))
    a, b = max(low, base), min(low + len(wide), base + len(x))
    if a < b:
        wide[a - low : b - low] = x[a - base : b - base]
    out = np.zeros(max(0, end - first))
    for phase in range(min(up, len(out))):  # outputs `up` apart have the same taps, and samples `down` apart
        start = start_of(first + phase)
        tap = (first + phase) * down - (start + np.arange(width)) * up + half
        taps = np.where((tap >= 0) & (tap < len(h)), h[np.clip(tap, 0, len(h) - 1)], 0.0)
        rows = np.lib.stride_tricks.sliding_window_view(wide, width)[start - low :: down]
        own = out[phase::up]
        for k in range(0, len(own), 1 << 14):
            own[k : k + (1 << 14)] = np.ascontiguousarray(rows[k : min(len(own), k + (1 << 14))]) @ taps
    return out
