"""Modified Kneser-Ney models over n-grams of small classes, packed into integers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix64


@dataclass
class KneserNey:
    """Sorted hashes of (order, group, n-gram) with the interpolated log10 probability, and the
    log10 back-off weight of the n-gram as a context."""

    order: int
    bits: int
    hashes: np.ndarray
    logp: np.ndarray
    context_hashes: np.ndarray
    backoff: np.ndarray

    @staticmethod
    def key(order: int, codes: np.ndarray) -> np.ndarray:
        return mix64(codes.astype(np.uint64) + np.uint64((order + 1) << 40))

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.full(len(wanted), missing), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        return np.where(hit, values[at], missing), hit

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last class of each n-gram, backing off from the highest order to 0."""
        total, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(self.order, -1, -1):
            if not len(open_):
                break
            part = low(codes[open_], order, self.order, self.bits)
            unseen = 0.0 if order else -self.bits * np.log10(2.0)  # a group without counts: all classes alike
            value, hit = self._find(self.hashes, self.logp, self.key(order, part), unseen)
            total[open_] += value
            open_, part = open_[~hit], part[~hit]
            if order and len(open_):  # not seen: the weight of its context, 1 where that is unseen too
                weight, _ = self._find(self.context_hashes, self.backoff, self.key(order - 1, context(part, order, self.order, self.bits)), 0.0)
                total[open_] += weight
        return total


def low(codes: np.ndarray, order: int, top: int, bits: int) -> np.ndarray:
    """The last `order` classes of an n-gram code, with the group that stands above the bits of the highest order."""
    return (codes >> (top * bits) << (top * bits)) | (codes & ((1 << (bits * order)) - 1))


def context(codes: np.ndarray, order: int, top: int, bits: int) -> np.ndarray:
    """An n-gram code of that order without its last class."""
    return (codes >> (top * bits) << (top * bits)) | ((codes & ((1 << (bits * order)) - 1)) >> bits)


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Discounts for counts of 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [0.0, 1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
    return [min(max(v, 0.05), k - 0.05) if k else 0.0 for k, v in enumerate(d)]


def fit_kneser_ney(codes: np.ndarray, counts: np.ndarray, top: int, bits: int) -> KneserNey:
    """Modified Kneser-Ney with three discounts for each order and language group.

    The highest order uses counts, lower orders the number of distinct classes before the n-gram.
    With no counts at all every class has probability 2 ** -bits.
    """
    keys, values, ckeys, cvalues = [], [], [], []
    groups = np.unique(codes >> (top * bits))
    level: dict[int, tuple[np.ndarray, np.ndarray]] = {top: (codes, counts.astype(np.float64))}
    for order in range(top - 1, 0, -1):
        part, n = np.unique(low(level[order + 1][0], order, top, bits), return_counts=True)
        level[order] = (part, n.astype(np.float64))
    every = groups << (top * bits)
    keys.append(KneserNey.key(0, every))
    values.append(np.full(len(every), -bits * np.log10(2.0)))
    below_codes, below = every, np.full(len(every), 2.0**-bits)
    for order in range(1, top + 1):
        code, n = level[order]
        srt = np.argsort(code, kind="stable")
        code, n = code[srt], n[srt]
        group = code >> (top * bits)
        discount = np.zeros(len(code))
        kinds = np.minimum(n, 3).astype(int)
        for g in np.unique(group):
            own = group == g
            d = discounts(*(float(np.sum(n[own] == k)) for k in (1, 2, 3, 4)))
            discount[own] = np.array(d)[kinds[own]]
        ctx = context(code, order, top, bits)
        ctx_code, at = np.unique(ctx, return_inverse=True)
        whole = np.bincount(at, n)
        gamma = np.bincount(at, discount) / whole
        lower_code = low(code, order - 1, top, bits)
        base = below[np.searchsorted(below_codes, lower_code)]
        p = (n - discount) / whole[at] + gamma[at] * base
        keys.append(KneserNey.key(order, code))
        values.append(np.log10(p))
        ckeys.append(KneserNey.key(order - 1, ctx_code))
        cvalues.append(np.log10(gamma))
        below_codes, below = code, p
    k, v = np.concatenate(keys), np.concatenate(values)
    ck = np.concatenate(ckeys) if ckeys else np.zeros(0, np.uint64)
    cv = np.concatenate(cvalues) if cvalues else np.zeros(0)
    a, b = np.argsort(k), np.argsort(ck)
    return KneserNey(top, bits, k[a], v[a], ck[b], cv[b])
