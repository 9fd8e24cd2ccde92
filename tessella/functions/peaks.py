"""Peaks of a sequence by height, distance and prominence."""

from __future__ import annotations

import numpy as np


def _sides(y: np.ndarray) -> np.ndarray:
    """For each place the smallest value back to the nearest higher one (or the beginning), itself included; each place is stacked once."""
    low = y.copy()
    stack: list[int] = []  # values descend
    for k, v in enumerate(y.tolist()):
        least = v
        while stack and y[stack[-1]] <= v:
            least = min(least, low[stack.pop()])
        low[k] = least
        stack.append(k)
    return low


def prominences(y: np.ndarray) -> np.ndarray:
    """How far each value stands above the higher of the lowest points towards the next higher values on both sides."""
    return y - np.maximum(_sides(y), _sides(y[::-1])[::-1])


def local_peaks(y: np.ndarray) -> np.ndarray:
    """Places higher than both neighbours; of a flat top the middle, rounded down. The ends are none."""
    if len(y) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, y[1:] != y[:-1]))  # runs of equal values
    last = np.append(first[1:], len(y)) - 1
    v = y[first]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (first[top] + last[top]) // 2


def find_peaks(y: np.ndarray, height: float, distance: int, prominence: float) -> np.ndarray:
    """Local peaks of a least height; of two nearer than `distance` the higher stays (the later of equals); then those of a least prominence."""
    k = local_peaks(y)
    k = k[y[k] >= height]
    keep = np.ones(len(k), bool)
    for i in np.argsort(y[k], kind="stable")[::-1]:
        if keep[i]:
            near = slice(np.searchsorted(k, k[i] - distance, "right"), np.searchsorted(k, k[i] + distance, "left"))
            keep[near] = False
            keep[i] = True
    k = k[keep]
    return k[prominences(y)[k] >= prominence]
