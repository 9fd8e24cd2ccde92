"""Features of recordings that are one block, worked out for the frames of many recordings at once.

The results are those of `analysis` over rows of frames; here nothing of a frame leaves its task, as all frames of such a recording are there. A task
takes recordings in groups of some GROUP samples, so its memory does not depend on how many there are. `wanted` names the features that are
worked out; others are not touched, and neither are the spectra that only they need. Longer recordings go through `analysis.frame_rows`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DIGITS, FEATURES
from . import analysis
from .analysis import FFT, FRAME, GATE, HOP, LEVEL, PARTS, RATE, RHYTHM, STEP, STEPS, SUMMED, VOCODER, VOCODER_STEP
from .blocks import KEY, lists
from .recurrence import Runner, cascade

#: Samples of a group, about: its frames stay in a core's cache.
GROUP = 1 << 15
#: Bytes of contents whose results are one Arrow batch, about.
BATCH = 1 << 20
NAMES = list(FEATURES)
#: What features are worked out from.
SOURCES = {
    "pitch": {*NAMES[:12], "hnr_mean_db", "hnr_std_db", *NAMES[44:48]}, "formants": set(NAMES[12:18]), "cepstra": {"cpp_mean_db", "cpp_std_db"}, "signs": {"zcr_mean"}, "entropy": {"energy_entropy"},
    "moments": {*NAMES[24:29], *NAMES[31:32], NAMES[33]}, "flux": {"spectral_flux_mean", "spectral_flux_std"}, "flatness": {"spectral_flatness_mean"}, "power": set(NAMES[34:37]), "rhythm": set(RHYTHM), "vocoder": set(NAMES[48:51]), "levels": set(NAMES[51:54]), "steps": set(NAMES[54:57]), "delays": set(NAMES[57:60]),
}


class Frames:
    """Frames of a group's recordings, where each begins: recording, number within it, first sample, and each recording's count."""

    def __init__(self, n: np.ndarray, off: np.ndarray, length: int, hop: int) -> None:
        self.counts = np.where(n >= length, (n - length) // hop + 1, 0)
        self.ends = np.cumsum(self.counts)
        self.rec = np.repeat(np.arange(len(n)), self.counts)
        self.k = np.arange(len(self.rec)) - (self.ends - self.counts)[self.rec]
        self.at = off[self.rec] + hop * self.k
        self.length = length

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(x, self.length)[self.at]

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Sums of rows by recording."""
        out = np.zeros((len(self.counts), *rows.shape[1:]))
        own = self.counts > 0
        if own.any():
            out[own] = np.add.reduceat(rows, (self.ends - self.counts)[own], axis=0)
        return out


def means(rec: np.ndarray, v: np.ndarray, groups: int) -> np.ndarray:
    """Mean of the values of each recording, NaN left out and where there is none."""
    own = ~np.isnan(v)
    rec, v = rec[own], v[own]
    with np.errstate(invalid="ignore"):
        return np.bincount(rec, v, groups) / np.bincount(rec, minlength=groups)


def deviations(rec: np.ndarray, v: np.ndarray, groups: int) -> np.ndarray:
    return np.sqrt(means(rec, (v - means(rec, v, groups)[rec]) ** 2, groups))


def spread(rec: np.ndarray, v: np.ndarray, groups: int) -> list[np.ndarray]:
    """`perturbation.perturbation`: local, three-point and five-point, and steps in dB."""
    n, mean = np.bincount(rec, minlength=groups), means(rec, v, groups)
    good = (n >= 5) & (np.nan_to_num(mean) > 0)
    out = []
    next_to = rec[1:] == rec[:-1]
    out.append(np.bincount(rec[1:][next_to], np.abs(np.diff(v))[next_to], groups) / np.maximum(np.bincount(rec[1:][next_to], minlength=groups), 1))
    for k in (1, 2):
        if len(v) <= 2 * k:
            out.append(np.zeros(groups))
            continue
        around = np.abs(v[k:-k] - sum(v[j : len(v) - 2 * k + j] for j in range(2 * k + 1)) / (2 * k + 1))
        inside, own = rec[2 * k :] == rec[: -2 * k], rec[k:-k]
        out.append(np.bincount(own[inside], around[inside], groups) / np.maximum(np.bincount(own[inside], minlength=groups), 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = [np.where(good, d / mean * 100, 0.0) for d in out]
        pair = next_to & (v[1:] > 0) & (v[:-1] > 0)
        db = np.abs(20 * np.log10(v[1:][pair] / v[:-1][pair]))
        return [*out, np.where(good, np.nan_to_num(means(rec[1:][pair], db, groups)), 0.0)]


def percentile(ordered: np.ndarray, share: float) -> float:
    at = (len(ordered) - 1) * share
    low = int(at)
    return ordered[low] if at == low else (low + 1 - at) * ordered[low] + (at - low) * ordered[low + 1]


def contours(out: dict[str, np.ndarray], rec: np.ndarray, f0: np.ndarray, lag: np.ndarray, amp: np.ndarray, n: np.ndarray) -> None:
    """What comes from the voiced frames' pitch, period and amplitude; `n` counts all frames."""
    groups = len(n)
    k, mean, std = np.bincount(rec, minlength=groups), means(rec, f0, groups), deviations(rec, f0, groups)
    ends = np.cumsum(k)
    low, high, wide, var, turns = np.zeros((5, groups))
    tone = 12 * np.log2(f0 / 100)
    for r in np.flatnonzero(k >= 2):
        own = f0[ends[r] - k[r] : ends[r]]
        low[r], high[r] = own.min(), own.max()
        if k[r] >= 5:
            st = np.sort(tone[ends[r] - k[r] : ends[r]])
            wide[r] = max(percentile(st, 0.95) - percentile(st, 0.05), 0.0)
            var[r] = (np.diff(own) / 0.01).var()
            steps = np.diff(own / 0.01)
            up = steps[np.abs(steps) > 10] > 0
            turns[r] = np.count_nonzero(up[1:] != up[:-1])
    enough = k >= 2
    for name, v in zip(NAMES[:4], (mean, std, low, high), strict=True):
        out[name] = np.where(enough, v, 0.0)
    out["pitch_voiced_fraction"] = k / np.maximum(n, 1)
    out |= zip(NAMES[5:8], spread(rec, lag, groups)[:3], strict=True)
    out |= zip(NAMES[8:12], spread(rec, amp, groups), strict=True)
    flat = (k >= 5) & ((std < 8) | (wide < 2))
    out |= zip(NAMES[44:48], (wide, var, flat.astype(float), turns), strict=True)


def formants(out: dict[str, np.ndarray], rec: np.ndarray, hz: np.ndarray, groups: int) -> None:
    f = [np.nan_to_num(means(rec, hz[:, k], groups)) for k in range(4)]
    with np.errstate(divide="ignore"):
        gap = np.where((f[3] > 0) & (f[0] > 0), (f[3] - f[0]) / 3, np.where((f[2] > 0) & (f[0] > 0), (f[2] - f[0]) / 2, 1000.0))
        tract = np.where(gap > 0, np.clip(17500 / gap, 10.0, 25.0), 17.5)
    framed = np.bincount(rec, minlength=groups) > 0
    out |= zip(NAMES[12:18], [np.where(framed, v, 0.0) for v in (*f, gap, tract)], strict=True)


def corners(upper: np.ndarray, height: int) -> float:
    """Share of the two-dimensional spectrum in its outer corners, from the half of it that is not conjugate: rows over time of one recording."""
    wide = len(upper)
    full = np.abs(np.fft.fft(upper, axis=0))  # (time, frequency)
    full[0, 0] = 0.0
    outer = lambda at, n: ((at + n // 2) % n < 4) | ((at + n // 2) % n >= n - 4)
    at, k = np.arange(wide), np.arange(full.shape[1])
    twice = (k > 0) & (k < height - k)
    rows = full.sum(axis=0)
    here = full[outer(at, wide)][:, outer(k, height)].sum()
    there = full[outer(-at, wide)][:, twice & outer(-k, height)].sum()
    return (here + there) / (rows.sum() + rows[twice].sum() + 1e-9)


@lru_cache(maxsize=1)
def _envelope() -> Runner:
    return Runner(cascade(analysis.BANDPASS))


def group_features(out: dict[str, np.ndarray], need: set[str], recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Adds to `out` the features that come from the needed sources; (recording, prediction polynomial) of frames, as their resonances are sought for many groups at once."""
    groups = len(recordings)
    n = np.array([len(r) for r in recordings])
    room = -(-np.maximum(n, FFT) // 320) * 320  # whole levels and whole chunks of the filter
    off = np.cumsum(room) - room
    x = np.zeros(int(room.sum()))
    for r, o in zip(recordings, off.tolist(), strict=True):
        x[o : o + len(r)] = r
    levels = Frames(n, off, LEVEL, LEVEL)
    pitch = Frames(n, off, FRAME, HOP)
    cells = pitch.at // LEVEL  # room is a multiple of LEVEL
    three = lambda v, join: join(join(v[cells], v[cells + 1]), v[cells + 2])
    power = None
    if need & {"levels", "entropy"}:
        power = np.einsum("ij,ij->i", x.reshape(-1, LEVEL), x.reshape(-1, LEVEL))
    if "levels" in need:
        own = (n >= 4 * LEVEL)[levels.rec] & (levels.k > 0)
        at = levels.at[own]
        db = 20 * np.log10(np.sqrt(power / LEVEL) + 1e-8)
        jump, turn = np.abs(db[at // LEVEL] - db[at // LEVEL - 1]), np.abs(x[at] - x[at - 1])
        most = np.zeros((2, groups))
        for k, v in enumerate((jump, turn)):
            np.maximum.at(most[k], levels.rec[own], v)
        out |= zip(NAMES[51:54], (np.bincount(levels.rec[own], jump > 18.0, groups), most[0], most[1] * np.pi), strict=True)
    if "entropy" in need:
        own = pitch.k < 50
        rec, e = pitch.rec[own], three(power, np.add)[own]
        share = e / (np.bincount(rec, e, groups) + 1e-8)[rec]
        out["energy_entropy"] = np.bincount(rec, np.where(e > 0, -share * np.log2(share + 1e-12), 0.0), groups)
    if need & {"pitch", "cepstra"} and len(pitch.rec):
        m2 = np.fft.rfft(pitch.of(x) * np.hanning(FRAME), 1024, axis=1)
        m2 = m2.real**2 + m2.imag**2
        if "pitch" in need:
            row, (low, high) = np.arange(len(m2)), analysis.LAGS
            f0, lag, hnr = analysis.pitch_of(np.fft.irfft(m2, axis=1))
            voiced = f0 > 0
            amp = three(np.abs(x.reshape(-1, LEVEL)).max(axis=1), np.maximum)
            contours(out, pitch.rec[voiced], f0[voiced], lag[voiced], amp[voiced], pitch.counts)
            out["hnr_mean_db"], out["hnr_std_db"] = means(pitch.rec, hnr, groups), deviations(pitch.rec, hnr, groups)
        if "cepstra" in need:
            cpp = analysis.prominence_of(np.sqrt(m2))
            out["cpp_mean_db"], out["cpp_std_db"] = means(pitch.rec, cpp, groups), deviations(pitch.rec, cpp, groups)
    if "signs" in need and len(pitch.rec):
        s = np.sign(x).astype(np.int64)
        moved = np.concatenate([[0], np.cumsum(np.abs(np.diff(s)))])
        first, last = pitch.at + 1, pitch.at + FRAME - 2  # the window is 0 at both ends
        out["zcr_mean"] = means(pitch.rec, (moved[last] - moved[first] + np.abs(s[first]) + np.abs(s[last])) / (2 * (FRAME - 1)), groups)
    if "rhythm" in need:
        runner = _envelope()
        first = np.repeat(off // runner.chunk, room // runner.chunk)
        passed = runner.run_all(x.reshape(-1, runner.chunk), np.arange(len(first)) - first).reshape(-1, LEVEL)
        envelope = np.sqrt(three(np.einsum("ij,ij->i", passed, passed), np.add) / FRAME)
        rows = np.array([analysis.envelope_rhythm(envelope[b - c : b], k / RATE) if c else np.zeros(len(RHYTHM)) for b, c, k in zip(pitch.ends.tolist(), pitch.counts.tolist(), n.tolist(), strict=True)])
        out |= zip(RHYTHM, rows.T, strict=True)
    if need & {"moments", "flux", "flatness", "power", "steps", "delays", "vocoder"}:
        spectra(out, need, x, n, off)
    if "formants" not in need or not len(pitch.rec):
        return np.zeros(0, np.int64), np.zeros((0, analysis.ORDER + 1))
    y = np.append(x[:1], x[1:] - 0.97 * x[:-1])
    y[off] = x[off]
    return pitch.rec, analysis.predictors(pitch.of(y) * np.hamming(FRAME), analysis.ORDER)


def spectra(out: dict[str, np.ndarray], need: set[str], x: np.ndarray, n: np.ndarray, off: np.ndarray) -> None:
    """What comes from spectra of FFT samples and from the vocoder's."""
    groups, sums = len(n), [analysis.Sums(0) for _ in n]
    if need & {"moments", "flux", "flatness", "power", "steps", "delays"}:
        f = Frames(np.maximum(n, FFT), off, FFT, STEP)
        windowed = f.of(x) * np.hanning(FFT)
        z = np.fft.rfft(windowed, axis=1)
        m2 = z.real**2 + z.imag**2
        m = np.sqrt(m2)
        if "moments" in need:
            rows = analysis.spectral_frames(m, None, shape=True)
            out |= {f"spectral_{name}_mean": means(f.rec, v, groups) for name, v in zip(("centroid", "spread", "skewness", "kurtosis", "", "rolloff", "", "crest_factor"), rows.T, strict=True) if name}
            out["spectral_centroid_std"] = deviations(f.rec, rows[:, 0], groups)
        if "flux" in need:
            flux = np.where(f.k > 0, analysis.flux_of(m, None), np.nan)
            own = ~np.isnan(flux)
            out["spectral_flux_mean"], out["spectral_flux_std"] = means(f.rec, flux, groups), deviations(f.rec[own], flux[own], groups)
        if "flatness" in need:
            out["spectral_flatness_mean"] = means(f.rec, analysis.flatness_of(m), groups)
        if "power" in need:
            out |= zip(SUMMED[:3], analysis.high_measures(f.sums(m2) / f.counts[:, None]), strict=True)
        long = f.counts >= 3
        if need & {"steps", "delays"} and long.any():
            phase = np.arctan2(z.imag, z.real)
            starts = f.ends - f.counts
            if "steps" in need:
                away = np.abs(analysis.wrapped(np.diff(phase, axis=0)) / (2 * np.pi) - np.linspace(0, 0.5, z.shape[1]))
                bits = m.astype(np.float32).view(np.uint32) >> 16
                for r in np.flatnonzero(long).tolist():
                    own, a = slice(starts[r], f.ends[r] - 1), away[starts[r] : f.ends[r] - 1].ravel()
                    sums[r].total["steps"] = np.array([a.size, a.sum(), a @ a])
                    b = bits[own].ravel()
                    b = b - b.min()
                    sums[r].counts, sums[r].away = np.bincount(b).astype(float), np.bincount(b, a)
            if "delays" in need:
                y = np.fft.rfft(windowed * np.arange(FFT), axis=1)
                delay = f.sums((z.real * y.real + z.imag * y.imag) / (m + 1e-6) ** 1.8)
                slope = analysis.wrapped(np.diff(phase, axis=1))
                bend = np.abs(np.diff(slope, axis=1)).sum(axis=1)
                cells = np.clip(((slope + np.pi) * (STEPS * PARTS / (2 * np.pi))).astype(np.int32), 0, STEPS * PARTS - 1)
                for r in np.flatnonzero(long).tolist():
                    own, s = slice(starts[r], f.ends[r]), sums[r]
                    s.total["delay"], s.frames["delay"] = delay[r], f.counts[r]
                    s.total["bend"] = np.array([f.counts[r] * (slope.shape[1] - 1), bend[own].sum()])
                    s.least, s.most = slope[own].min(), slope[own].max()
                    s.total["slopes"] = np.bincount(cells[own].ravel(), minlength=STEPS * PARTS).astype(float)
    if "vocoder" in need:
        v = Frames(np.where((n >= 2 * VOCODER) & ((n - VOCODER) // VOCODER_STEP + 1 >= 8), n, 0), off, VOCODER, VOCODER_STEP)
        ratio, smeared = np.zeros((2, groups))
        if len(v.rec):
            m = np.abs(np.fft.rfft(v.of(x) * np.hanning(VOCODER), axis=1))
            half = m[:, int(m.shape[1] * 0.4) :]
            upper = np.fft.rfft(half, axis=1)
            smeared = np.where(v.counts > 0, analysis.smearing(v.sums(m) / np.maximum(v.counts, 1)[:, None]), 0.0)
            for r in np.flatnonzero(v.counts >= 16).tolist():
                ratio[r] = corners(upper[v.ends[r] - v.counts[r] : v.ends[r]], half.shape[1])
        out |= zip(NAMES[48:51], (ratio, (ratio > 0.08).astype(float), smeared), strict=True)
    if need & {"steps", "delays"}:
        out |= zip(SUMMED[4:], np.array([s.result() for s in sums]).T[4:], strict=True)


def measured(recordings: list[np.ndarray], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(peaks, rows of the named features) of recordings that have samples, not rounded; 0 where a recording is too short for one."""
    need = {s for s, own in SOURCES.items() if own & set(names)}
    found, rec, polynomials, start, held = [], [], [], 0, 0
    for k, x in enumerate(recordings):
        held += len(x)
        if held >= GROUP or k == len(recordings) - 1:
            out: dict[str, np.ndarray] = {}
            own, a = group_features(out, need, recordings[start : k + 1])
            found.append(np.column_stack([out.get(c, np.zeros(k + 1 - start)) for c in names]))
            rec.append(own + start)
            polynomials.append(a)
            start, held = k + 1, 0
    peaks = np.array([max(x.max(), -x.min()) for x in recordings], float)
    rows = np.concatenate(found) if found else np.zeros((0, len(names)))
    if "formants" in need and found:
        out = {}
        formants(out, np.concatenate(rec), analysis.resonances(np.concatenate(polynomials)), len(recordings))
        for c in out.keys() & set(names):
            rows[:, names.index(c)] = out[c]
    rows[np.isnan(rows)] = 0.0
    return peaks, rows


def table(peaks: DataFrame, names: list[str], parity: bool = True, keep: tuple[str, ...] = (KEY,)) -> DataFrame:
    """The named features of rows (keep, n, peak, v), gated and rounded."""
    loud = F.col("peak") >= GATE
    value = lambda k, c: F.lit(0.0) if parity and c == "energy_entropy" else F.when(loud, F.round(F.col("v")[k], DIGITS[c])).otherwise(0.0)
    return peaks.select(*keep, (F.col("n") / RATE).alias("duration_sec"), *[value(k, c).alias(c) for k, c in enumerate(names)])


def whole_features(recordings: DataFrame, names: list[str] | None = None, parity: bool = True, copies: Callable[[int, np.ndarray], list[np.ndarray]] | None = None) -> DataFrame:
    """The columns of recordings (recording_id, content of unsigned 8-bit samples, and others) but the content, duration_sec and the named features; no row for empty ones. No shuffle.

    With `copies`, a recording is measured as each of the sample arrays that it gives for its id and samples, in a row of its own with its number as `copy`.
    """
    names, others = list(names or NAMES), [c for c in recordings.columns if c not in (KEY, "content")]
    kinds = dict(recordings.dtypes)
    own_columns = [KEY, *others, *["copy"] * (copies is not None)]
    schema = ", ".join([f"{KEY} long", *[f"{c} {kinds[c]}" for c in others], *["copy int"] * (copies is not None), "n long, peak double, v array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            peak, rows = measured([(x.astype(float) - 128) / 128 for _, _, x in held], names)
            taken = [batch.column(c).take(pa.array([k for k, _, _ in held])) for c in (KEY, *others)]
            made = [pa.array([j for _, j, _ in held], pa.int32())] * (copies is not None)
            return pa.RecordBatch.from_arrays([*taken, *made, pa.array([len(x) for _, _, x in held], pa.int64()), pa.array(peak), lists(list(rows))], [*own_columns, "n", "peak", "v"])

        for batch in batches:
            held, size = [], 0
            for k, content in enumerate(batch.column("content")):
                raw = np.frombuffer(content.as_buffer(), np.uint8) if content.is_valid else np.zeros(0, np.uint8)
                if len(raw):
                    held += [(k, j, x) for j, x in enumerate(copies(batch.column(KEY)[k].as_py(), raw) if copies else [raw])]
                    size += len(raw)
                if size >= BATCH:
                    yield emit()
                    held, size = [], 0
            if held:
                yield emit()

    got = recordings.select(F.col(KEY).cast("long").alias(KEY), *others, "content").mapInArrow(run, schema)
    return table(got, names, parity, tuple(own_columns))
