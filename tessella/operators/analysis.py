"""The five analysers over the samples of recordings: one pass over blocks, mergeable partial results, 60 features.

`frame_rows` reads each block once (with the samples around it) and gives rows of frames, and sums of a block where frames do not matter on
their own. Frames belong to the block they begin in, so a recording's rows do not depend on how it is cut. What needs the order of frames
(steps of pitch, level jumps) are windows over frames; what needs a whole envelope or the sums of all blocks is streamed by recording.

Magnitudes' 80th percentile and the histogram of phase steps come from counts in narrow bins (under one percent of a magnitude; a 128th of a
histogram bin), as their cells are as many as samples; both results are exact but for values within the bin that is cut.

Defined results: a recording without samples has no row; one whose peak is under GATE has zeros; one too short for a measure has
0 there. Samples are at RATE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.peaks import find_peaks, prominences
from ..schema import DIGITS, FEATURES
from . import perturbation
from .blocks import KEY, lists, rows_of, runs
from .recurrence import Runner, cascade, with_starts

RATE, GATE = 16000, 0.015
#: Length and step of pitch and level frames, of spectra, and of the vocoder's spectra.
FRAME, HOP, LEVEL, FFT, STEP, VOCODER, VOCODER_STEP = 480, 160, 160, 1024, 256, 512, 128
#: Samples of a block, a multiple of every step, and those it needs around it. What blocks of longer recordings share is some ten times their samples, so blocks are as
#: long as a task's memory likes (under 150 MB for one).
SIZE, BEFORE, AFTER = 1280 * 128, STEP, FFT
#: Pitch lags, voicing, prediction order, quefrencies.
LAGS, VOICED, ORDER, QUEFRENCY = (RATE // 500, RATE // 50), 0.45, 2 + RATE // 1000, (20, 200)
BANDPASS = kernels.butterworth(2, (200.0, 3000.0), RATE, "band")
#: Kinds of rows that add up over a recording's blocks.
ADDED = ("power", "harmonics", "steps", "strong", "delay", "bend", "slopes")
#: Bins of the phase histogram: 30, each in so many parts.
STEPS, PARTS = 30, 128
FINE = np.linspace(-np.pi, np.pi, STEPS * PARTS + 1)

ROW = "recording_id long, n long, idx long, key int, v array<double>, w array<double>, kind string"
PITCH = ("f0", "lag", "amp", "hnr", "cpp", "zcr", "energy", "f1", "f2", "f3", "f4")
SPECTRAL = ("centroid", "spread", "skewness", "kurtosis", "flux", "rolloff", "flatness", "crest")


def _frames(x: np.ndarray, base: int, low: int, high: int, n: int, length: int, hop: int) -> tuple[int, np.ndarray]:
    """(first frame, frames as rows) of those that begin in [low, high) and end within n samples; x begins at sample `base`."""
    first, last = -(-low // hop), min((high - 1) // hop, (n - length) // hop)
    if last < first:
        return first, np.zeros((0, length))
    part = x[first * hop - base : last * hop - base + length]
    return first, np.lib.stride_tricks.sliding_window_view(part, length)[::hop]


def predictors(frames: np.ndarray, order: int) -> np.ndarray:
    """Prediction polynomials of all frames at once, by the Levinson-Durbin recursion; ones for a frame of zeros."""
    n = frames.shape[1]
    r = np.stack([np.einsum("ij,ij->i", frames[:, : n - k], frames[:, k:]) for k in range(order + 1)], axis=1)  # summed as is, so that zeros stay zeros
    a = np.zeros((len(frames), order + 1))
    a[:, 0] = 1.0
    error, on = r[:, 0].copy(), r[:, 0] != 0
    for m in range(1, order + 1):
        gamma = np.where(on, -np.einsum("ij,ij->i", a[:, :m], r[:, m:0:-1]) / (error + 1e-8), 0.0)
        a[:, 1 : m + 1] += gamma[:, None] * a[:, m - 1 :: -1][:, :m]
        error = np.where(on, error * (1 - gamma**2), error)
        on &= error > 0
    a[r[:, 0] == 0] = 1.0
    return a


def roots_of(polynomials: np.ndarray, rounds: int = 40, near: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(roots, settled) of rows of polynomials whose first coefficient is 1 and last is not 0: Aberth's iteration for all rows at once, whose last step is under `near` where it has settled."""
    n, left = polynomials.shape[1] - 1, np.arange(len(polynomials))
    c = np.ascontiguousarray(polynomials[:, 1:].T)
    z = np.abs(c[-1]) ** (1 / n) * np.exp(2j * np.pi * (np.arange(n)[:, None] + 0.25) / n)
    out, settled = np.zeros((len(left), n), complex), np.zeros(len(left), bool)
    with np.errstate(all="ignore"):
        for k in range(rounds):
            p, d = z + c[0], np.ones_like(z)
            for coefficient in c[1:]:
                d *= z
                d += p
                p *= z
                p += coefficient
            x, y = z.real.copy(), z.imag.copy()
            sx, sy = np.zeros_like(x), np.zeros_like(y)
            for i in range(n - 1):  # sums of 1 / (z_i - z_j), each pair once
                dx, dy = x[i] - x[i + 1 :], y[i] - y[i + 1 :]
                square = dx * dx
                square += dy * dy
                dx /= square
                dy /= square
                sx[i] += dx.sum(axis=0)
                sy[i] -= dy.sum(axis=0)
                sx[i + 1 :] -= dx
                sy[i + 1 :] += dy
            step = p / (d - p * (sx + 1j * sy))
            z = z - step
            done = (np.abs(step.real) + np.abs(step.imag)).max(axis=0) < near
            if done.mean() > 0.2 or k == rounds - 1:
                out[left[done]], settled[left[done]] = z[:, done].T, True
                z, c, left = z[:, ~done], np.ascontiguousarray(c[:, ~done]), left[~done]
                if not len(left):
                    break
    return out, settled


def resonances(polynomials: np.ndarray, rate: float = RATE, low: float = 200.0, high: float = 5000.0, most: int = 4) -> np.ndarray:
    """The lowest `most` resonances of each row, ascending, NaN where there are fewer: angles of roots in the upper half-plane within the unit circle."""
    n = polynomials.shape[1] - 1
    roots, settled = np.zeros((len(polynomials), n), complex), np.zeros(len(polynomials), bool)
    whole = np.flatnonzero(polynomials[:, -1] != 0)
    if len(whole) >= 64:  # fewer do not pay for the steps
        for part in np.array_split(whole, -(-len(whole) // 1024)):
            roots[part], settled[part] = roots_of(polynomials[part])
    rest = whole[~settled[whole]]
    if len(rest):
        companion = np.zeros((len(rest), n, n))
        companion[:, np.arange(1, n), np.arange(n - 1)] = 1.0
        companion[:, 0, :] = -polynomials[rest, 1:]
        roots[rest] = np.linalg.eigvals(companion)
    for k in np.flatnonzero(polynomials[:, -1] == 0):  # of lower degree: the roots at zero must not be perturbed
        own = np.roots(polynomials[k])
        roots[k] = np.append(own, np.zeros(n - len(own)))
    hz = np.angle(roots) * rate / (2 * np.pi)
    hz[(roots.imag <= 0.01) | (np.abs(roots) >= 0.999) | (hz < low) | (hz > high)] = np.nan
    return np.sort(hz, axis=1)[:, :most]  # NaN sorts last


def pitch_of(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pitch, period, harmonics to noise) of frames from their autocorrelation; pitch 0 and period NaN where a frame is not voiced."""
    low, high = LAGS
    row = np.arange(len(r))
    lag = low + np.argmax(r[:, low:high], axis=1)
    share = r[row, lag] / (r[:, 0] + 1e-8)
    a, b, c = (r[row, lag + k] for k in (-1, 0, 1))
    refined = lag + (a - c) / (2 * (2 * b - a - c) + 1e-8)
    voiced = share >= VOICED
    hnr = np.where(share >= 0.999, 30.0, np.where(share <= 0.01, 0.0, 10 * np.log10(np.clip(share, 1e-9, None) / np.clip(1 - share, 1e-9, None))))
    return np.where(voiced, RATE / refined, 0.0), np.where(voiced, refined / RATE, np.nan), hnr


def prominence_of(m: np.ndarray) -> np.ndarray:
    """Height of the cepstrum's peak over its mean in dB, from magnitude spectra."""
    cepstrum = np.abs(np.fft.irfft(np.log(np.maximum(m, 1e-6)), axis=1)[:, slice(*QUEFRENCY)])
    top = cepstrum.max(axis=1, initial=0)
    return np.where(top > 1e-12, 20 * np.log10(np.maximum(top, 1e-12) / (cepstrum.mean(axis=1) + 1e-8)), 0.0)


def pitch_frames(frames: np.ndarray, emphasised: np.ndarray) -> np.ndarray:
    """A row of PITCH for each frame."""
    windowed = frames * np.hanning(FRAME)
    m = np.abs(np.fft.rfft(windowed, 1024, axis=1))
    f0, lag, hnr = pitch_of(np.fft.irfft(m**2, axis=1))
    zcr = np.abs(np.diff(np.sign(windowed), axis=1)).mean(axis=1) / 2
    columns = [f0, lag, np.abs(frames).max(axis=1, initial=0), hnr, prominence_of(m), zcr, (frames**2).sum(axis=1)]
    return np.column_stack([*columns, resonances(predictors(emphasised * np.hamming(FRAME), ORDER))])


def flux_of(m: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Root of the mean square of what magnitudes rise by from frame to frame; NaN for a first frame without one before it."""
    rise = np.maximum(0, np.diff(m if before is None else np.vstack([before, m]), axis=0))
    flux = np.sqrt(np.einsum("ij,ij->i", rise, rise) / m.shape[1])
    return flux if before is not None else np.append(np.nan, flux)


def flatness_of(m: np.ndarray) -> np.ndarray:
    """Geometric over arithmetic mean of magnitudes."""
    return np.exp(np.log(m + 1e-10).mean(axis=1)) / (m.mean(axis=1) + 1e-10)


def spectral_frames(m: np.ndarray, before: np.ndarray | None, shape: bool = False) -> np.ndarray:
    """A row of SPECTRAL for each magnitude spectrum; flux against the one before it, NaN for a recording's first. With `shape`, flux and flatness are left 0."""
    hz = np.linspace(0, RATE / 2, m.shape[1])
    p = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-9)
    centroid = p @ hz
    away = hz - centroid[:, None]
    square = away * away
    spread = np.sqrt(np.einsum("ij,ij->i", p, square) + 1e-12)
    skew, kurt = (np.einsum("ij,ij,ij->i", p, square, other) / (spread**k + 1e-12) for k, other in ((3, away), (4, square)))
    power = np.cumsum(m**2, axis=1)
    rolloff = hz[np.argmax(power >= 0.85 * power[:, -1:], axis=1)]
    crest = m.max(axis=1) / (np.sqrt((m**2).mean(axis=1)) + 1e-10)
    flux, flat = np.zeros((2, len(m))) if shape else (flux_of(m, before), flatness_of(m))
    return np.column_stack([centroid, spread, skew, kurt, flux, rolloff, flat, crest])


def wrapped(d: np.ndarray) -> np.ndarray:
    """Steps of an unwrapped phase, from differences of angles."""
    return d - 2 * np.pi * (d > np.pi) + 2 * np.pi * (d < -np.pi)


def block_rows(n: int, block: int, base: int, x: np.ndarray, state: np.ndarray, runner: Runner, size: int) -> Iterator[tuple]:
    """(idx, key, v, w, kind) of one block."""
    low, high = block * size, min((block + 1) * size, n)
    none = np.zeros(0)
    yield block, 0, np.array([np.abs(x[low - base : high - base]).max()]), none, "peak"
    first, frames = _frames(x, base, low, high, n, FRAME, HOP)
    if len(frames):
        emphasised = np.append(x[:1], x[1:] - 0.97 * x[:-1])  # a block but the first begins after its predecessor's last samples
        for k, v in enumerate(pitch_frames(frames, _frames(emphasised, base, low, high, n, FRAME, HOP)[1])):
            yield first + k, 0, v, none, "pitch"
        passed, _ = runner.run(x[low - base :], state)
        for k, v in enumerate(np.sqrt((_frames(passed, low, low, high, n, FRAME, HOP)[1] ** 2).mean(axis=1))):
            yield first + k, 0, np.array([v]), none, "envelope"
    if n >= 4 * LEVEL:
        first, frames = _frames(x, base, low, high, n, LEVEL, LEVEL)
        db = 20 * np.log10(np.sqrt((frames**2).mean(axis=1)) + 1e-8)
        for k in range(len(frames)):
            yield first + k, 0, np.array([db[k], frames[k, 0], frames[k, -1]]), none, "level"
    padded, length = (np.append(x, np.zeros(FFT - n)), FFT) if n < FFT else (x, n)
    # the frame before a block's first one, for steps from it
    first, frames = _frames(padded, base, max(0, low - STEP), max(high, 1), length, FFT, STEP)
    if len(frames):
        windowed = frames * np.hanning(FFT)
        z = np.fft.rfft(windowed, axis=1)
        m = np.abs(z)
        own = slice(1 if low else 0, None)
        if len(m[own]):
            for k, v in enumerate(spectral_frames(m[own], m[:1] if low else None)):
                yield first + k + (1 if low else 0), 0, v, none, "spectral"
            yield block, 0, (m[own] ** 2).sum(axis=0), np.array([len(m[own])]), "power"
        if len(z) > 1:
            away = np.abs(wrapped(np.diff(np.angle(z), axis=0)) / (2 * np.pi) - np.linspace(0, 0.5, z.shape[1]))
            bins, at = np.unique((m[:-1].astype(np.float32).view(np.uint32) >> 16).ravel(), return_inverse=True)
            counts = np.bincount(at, minlength=len(bins)).astype(float)
            yield block, 0, np.array([away.size, away.sum(), (away**2).sum()]), none, "steps"
            yield block, 0, bins.astype(float), np.concatenate([counts, np.bincount(at, away.ravel(), minlength=len(bins))]), "strong"
        if n >= FFT and len(z[own]):
            y = np.fft.rfft(windowed[own] * np.arange(FFT), axis=1)
            delay = (z[own].real * y.real + z[own].imag * y.imag) / (m[own] + 1e-6) ** 1.8
            slope = wrapped(np.diff(np.angle(z[own]), axis=1))
            yield block, 0, delay.sum(axis=0), np.array([len(delay)]), "delay"
            bend = np.abs(np.diff(slope, axis=1))
            yield block, 0, np.array([bend.size, bend.sum(), slope.min(), slope.max()]), none, "bend"
            cells = np.clip(((slope + np.pi) / (2 * np.pi) * STEPS * PARTS).astype(int), 0, STEPS * PARTS - 1)
            yield block, 0, np.bincount(cells.ravel(), minlength=STEPS * PARTS).astype(float), none, "slopes"
    if n >= 2 * VOCODER and (n - VOCODER) // VOCODER_STEP + 1 >= 8:
        first, frames = _frames(x, base, low, high, n, VOCODER, VOCODER_STEP)
        if len(frames):
            m = np.abs(np.fft.rfft(frames * np.hanning(VOCODER), axis=1))
            yield block, 0, m.sum(axis=0), np.array([len(m)]), "harmonics"
            upper = np.fft.fft(m[:, int(m.shape[1] * 0.4) :], axis=1)
            if n <= size:
                yield block, 0, corner_sums(np.arange(upper.shape[1]), upper.T, upper.shape[1]), none, "corners"
            else:  # the other dimension runs over all blocks of the recording
                for k in range(upper.shape[1] // 2 + 1):  # the rest are their conjugates
                    yield block, k, upper[:, k].real, upper[:, k].imag, "grid"


def corner_sums(k: np.ndarray, series: np.ndarray, height: int) -> np.ndarray:
    """(in the four outer corners, overall, columns): magnitudes of the two-dimensional spectrum in rows k of `height`, each from its series over time; the mean is left out."""
    full = np.abs(np.fft.fft(series, axis=1))
    full[k == 0, 0] = 0.0
    outer = lambda at, n: ((at + n // 2) % n < 4) | ((at + n // 2) % n >= n - 4)
    wide = full.shape[1]
    corner = full[outer(k, height)][:, outer(np.arange(wide), wide)].sum()
    return np.array([corner, full.sum(), float(wide)])


def merged(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The rows of a recording of one block, with the result of its sums in place of them."""
    sums = Sums()
    for row in rows:
        if row[4] in ADDED:
            sums.add(row[4], row[2], row[3])
        else:
            yield row
    yield 0, 0, sums.result(), np.zeros(0), "sums"


def frame_rows(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows of every frame and block; blocks are cut with BEFORE and AFTER samples around them."""
    if size % 1280:
        raise ValueError("a block holds a multiple of 1280 samples")
    runner = Runner(cascade(BANDPASS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = zip(*(batch.column(c).to_pylist() for c in (KEY, "n", "block", "start")), rows_of(batch.column("samples")), rows_of(batch.column("state")), strict=True)
            for rid, n, block, start, x, state in heads:
                made = block_rows(n, block, start, x, state, runner, size)
                idx, key, v, w, kind = zip(*(merged(made) if n <= size else made), strict=True)
                ids = [pa.array([rid] * len(idx), pa.int64()), pa.array([n] * len(idx), pa.int64())]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(idx, pa.int64()), pa.array(key, pa.int32()), lists(list(v)), lists(list(w)), pa.array(kind)], [c.split()[0] for c in ROW.split(", ")])

    return with_starts(blocks, BANDPASS, size).select(KEY, "n", "block", "start", "samples", "state").mapInArrow(run, ROW)


def _named(rows: DataFrame, kind: str, names: tuple[str, ...]) -> DataFrame:
    value = lambda k: F.when(~F.isnan(F.col("v")[k]), F.col("v")[k])
    return rows.where(F.col("kind") == kind).select(KEY, "n", "idx", *[value(k).alias(name) for k, name in enumerate(names)])


def acoustic(rows: DataFrame) -> DataFrame:
    """Pitch, perturbation, voice quality and formants of each recording."""
    frames = _named(rows, "pitch", PITCH)
    contour = perturbation.pitch_stats(frames)
    voiced = frames.where("f0 > 0")
    jitter, shimmer = perturbation.perturbation(voiced, "lag", "jitter"), perturbation.perturbation(voiced, "amp", "shimmer")
    share = F.col("energy") / (F.sum("energy").over(Window.partitionBy(KEY)) + 1e-8)
    entropy = frames.where("idx < 50").select(KEY, "energy", (-share * F.log2(share + 1e-12)).alias("h")).where("energy > 0").groupBy(KEY).agg(F.sum("h").alias("energy_entropy"))
    means = frames.groupBy(KEY).agg(
        F.avg("hnr").alias("hnr_mean_db"), F.stddev_pop("hnr").alias("hnr_std_db"), F.avg("cpp").alias("cpp_mean_db"), F.stddev_pop("cpp").alias("cpp_std_db"), F.avg("zcr").alias("zcr_mean"),
        *[F.coalesce(F.avg(f"f{k}"), F.lit(0.0)).alias(f"formant_f{k}_mean") for k in range(1, 5)],
    )
    f1, f3, f4 = (F.col(f"formant_f{k}_mean") for k in (1, 3, 4))
    gap = F.when((f4 > 0) & (f1 > 0), (f4 - f1) / 3).when((f3 > 0) & (f1 > 0), (f3 - f1) / 2).otherwise(F.lit(1000.0))
    got = means.withColumn("formant_dispersion", gap).withColumn("vocal_tract_length_cm", F.when(gap > 0, F.greatest(F.lit(10.0), F.least(F.lit(25.0), 17500 / gap))).otherwise(17.5))
    names = {"mean_f0": "pitch_mean_f0", "std_f0": "pitch_std_f0", "min_f0": "pitch_min_f0", "max_f0": "pitch_max_f0", "voiced_fraction": "pitch_voiced_fraction"}
    got = got.join(contour.withColumnsRenamed(names), KEY).join(entropy, KEY, "left")
    got = got.join(jitter.select(KEY, "jitter_local_pct", F.col("jitter_three_pct").alias("jitter_rap_pct"), F.col("jitter_five_pct").alias("jitter_ppq5_pct")), KEY, "left")
    return got.join(shimmer.select(KEY, "shimmer_local_pct", F.col("shimmer_three_pct").alias("shimmer_apq3_pct"), F.col("shimmer_five_pct").alias("shimmer_apq5_pct"), "shimmer_db"), KEY, "left")


def spectral(rows: DataFrame) -> DataFrame:
    """Means over spectra; the high-frequency measures come from the recording's mean power."""
    got = _named(rows, "spectral", SPECTRAL).groupBy(KEY)
    means = {"centroid": "spectral_centroid_mean", "spread": "spectral_spread_mean", "skewness": "spectral_skewness_mean", "kurtosis": "spectral_kurtosis_mean", "flux": "spectral_flux_mean",
             "rolloff": "spectral_rolloff_mean", "flatness": "spectral_flatness_mean", "crest": "spectral_crest_factor_mean"}
    return got.agg(*[F.avg(c).alias(name) for c, name in means.items()], F.stddev_pop("centroid").alias("spectral_centroid_std"), F.stddev_pop("flux").alias("spectral_flux_std"))


def prosody(rows: DataFrame, speech: DataFrame | None = None) -> DataFrame:
    """Rhythm from each recording's envelope, intonation from its pitch; `speech` (recording_id, speech_sec) is the time articulation counts, all of it if absent."""
    voiced = _named(rows, "pitch", PITCH).where("f0 > 0")
    order = Window.partitionBy(KEY).orderBy("idx")
    stepped = voiced.select(KEY, "f0", (12 * F.log2(F.col("f0") / 100)).alias("st"), ((F.col("f0") - F.lag("f0").over(order)) / 0.01).alias("slope"))
    tone = stepped.groupBy(KEY).agg(F.count("*").alias("k"), F.greatest(F.percentile("st", 0.95) - F.percentile("st", 0.05), F.lit(0.0)).alias("range"), F.var_pop("slope").alias("var"), F.stddev_pop("f0").alias("std"))
    enough = F.col("k") >= 5
    flat = (F.col("std") < 8) | (F.col("range") < 2)
    tone = tone.select(KEY, enough.alias("enough"), F.when(enough, F.col("range")).otherwise(0.0).alias("prosody_f0_range_semitones"), F.when(enough, F.col("var")).otherwise(0.0).alias("prosody_pitch_slope_variance"), (enough & flat).cast("double").alias("prosody_is_monotone"))
    turns = perturbation.pitch_turns(voiced.select(KEY, "idx", "f0", (F.lit(0)).alias("z")).withColumn("f0", F.col("f0") / 0.01))
    tone = tone.join(turns, KEY, "left").select("*", F.when(F.col("enough"), F.coalesce("turns", F.lit(0))).otherwise(0).cast("double").alias("prosody_direction_changes")).drop("turns", "enough")
    got = rhythm(rows.where("kind = 'envelope'")).join(tone, KEY, "left")
    if speech is not None:
        got = got.join(speech, KEY, "left")
        spoken = F.col("speech_sec")
        got = got.withColumn("prosody_articulation_rate", F.when(spoken > 0, F.col("prosody_syllable_count") / spoken).otherwise(F.col("prosody_speaking_rate"))).drop("speech_sec")
    return got


RHYTHM = ("prosody_speaking_rate", "prosody_articulation_rate", "prosody_syllable_count", "prosody_pause_count", "prosody_mean_pause_sec", "prosody_npvi", "prosody_rpvi")


def envelope_rhythm(envelope: np.ndarray, seconds: float) -> np.ndarray:
    """RHYTHM of an envelope of 10 ms steps."""
    if len(envelope) < 5 or envelope.max() <= 1e-6:
        return np.zeros(len(RHYTHM))
    db = 20 * np.log10(envelope / envelope.max() + 1e-6)
    peaks = find_peaks(db, -30.0, 8, 1.5)
    gaps = np.diff(peaks * 0.010) * 1000
    steps = np.abs(np.diff(gaps))
    pair = (gaps[1:] + gaps[:-1]) / 2
    edges = np.flatnonzero(np.diff(np.concatenate([[0], db < -30, [0]])))
    pauses = edges[1::2] - edges[::2]
    pauses = pauses[pauses >= 20] * 0.010
    rate = len(peaks) / seconds
    return np.array([rate, rate, len(peaks), len(pauses), pauses.mean() if len(pauses) else 0.0, 100 * (steps / pair).mean() if len(steps) else 0.0, steps.mean() if len(steps) else 0.0])


def rhythm(envelopes: DataFrame) -> DataFrame:
    """RHYTHM of each recording; an envelope, a number for every 160 samples, is held by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            values = envelope_rhythm(np.concatenate(parts), last[1] / RATE)
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), *[pa.array([v]) for v in values]], [KEY, *RHYTHM])

        last, parts = None, []
        for key, rows in runs(batches, [KEY, "n"]):
            if key != last and parts:
                yield emit()
                parts = []
            last = key
            parts.append(np.concatenate(list(rows_of(rows.column("v")))))
        if parts:
            yield emit()

    ordered = envelopes.select(KEY, "n", "idx", "v").repartition(KEY).sortWithinPartitions(KEY, "n", "idx").select(KEY, "n", "v")
    return ordered.mapInArrow(run, f"{KEY} long, " + ", ".join(f"{c} double" for c in RHYTHM))


def splices(rows: DataFrame, jump_db: float = 18.0) -> DataFrame:
    levels = _named(rows, "level", ("db", "first", "last"))
    order = Window.partitionBy(KEY).orderBy("idx")
    steps = levels.select(KEY, F.abs(F.col("db") - F.lag("db").over(order)).alias("jump"), F.abs(F.col("first") - F.lag("last").over(order)).alias("turn"))
    return steps.groupBy(KEY).agg(F.count_if(F.col("jump") > jump_db).cast("double").alias("artifact_splice_points"), F.max("jump").alias("artifact_max_energy_jump_db"), (F.max("turn") * np.pi).alias("artifact_max_phase_jump_rad"))


def level_peaks(levels: DataFrame, height: float, distance: int, prominence: float) -> DataFrame:
    """(recording_id, frame_idx, db, prominence) of the peaks of levels (recording_id, frame_idx, db), frames without gaps; a recording's levels are held by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            y = rows.column("db").to_numpy()
            k = find_peaks(y, height, distance, prominence)
            return pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(k)) for c in (KEY, "frame_idx", "db")] + [pa.array(prominences(y)[k])], [KEY, "frame_idx", "db", "prominence"])

        last, parts = None, []
        for key, rows in runs(batches, [KEY]):
            if key != last and parts:
                yield emit()
                parts = []
            last = key
            parts.append(rows)
        if parts:
            yield emit()

    ordered = levels.select(KEY, "frame_idx", "db").repartition(KEY).sortWithinPartitions(KEY, "frame_idx")
    return ordered.mapInArrow(run, f"{KEY} long, frame_idx long, db double, prominence double")


SUMMED = ("spectral_hf_energy_ratio", "has_artificial_cutoff", "cutoff_frequency_hz", "artifact_harmonic_smearing", "phase_if_mean_deviation", "phase_if_variance", "phase_if_clustering",
          "phase_mgd_peak_prominence", "phase_dispersion_entropy", "phase_roughness")


class Sums:
    """What the blocks of a recording add up to."""

    def __init__(self, bins: int = 1 << 16) -> None:
        self.total: dict[str, np.ndarray] = {}
        self.frames: dict[str, float] = {}
        self.least, self.most = np.inf, -np.inf
        self.counts, self.away = np.zeros(bins), np.zeros(bins)

    def add(self, kind: str, v: np.ndarray, w: np.ndarray) -> None:
        if kind == "strong":
            at = v.astype(int)
            self.counts[at] += w[: len(at)]
            self.away[at] += w[len(at) :]
            return
        if kind == "bend":
            self.least, self.most, v = min(self.least, v[2]), max(self.most, v[3]), v[:2]
        self.total[kind] = self.total.get(kind, 0.0) + v
        self.frames[kind] = self.frames.get(kind, 0.0) + (w[0] if len(w) else 0.0)

    def result(self) -> np.ndarray:
        out = dict.fromkeys(SUMMED, 0.0)
        if "power" in self.total:
            out |= zip(SUMMED[:3], high_measures((self.total["power"] / self.frames["power"])[None])[:, 0], strict=True)
        if "harmonics" in self.total:
            out["artifact_harmonic_smearing"] = smearing((self.total["harmonics"] / self.frames["harmonics"])[None])[0]
        steps = self.total.get("steps")
        if steps is not None and steps[0] >= 2 * (FFT // 2 + 1):  # three frames
            mean = steps[1] / steps[0]
            out |= {"phase_if_mean_deviation": mean, "phase_if_variance": max(0.0, steps[2] / steps[0] - mean**2), "phase_if_clustering": 1 / (1 + 2 * self.strong())}
        if "delay" in self.total and self.frames["delay"] >= 3:
            delay = self.total["delay"] / self.frames["delay"]
            out["phase_mgd_peak_prominence"] = min(max(delay.std() / (np.abs(delay).mean() + 1e-6) / 5, 0.0), 1.0)
            out["phase_roughness"] = self.total["bend"][1] / self.total["bend"][0]
            out["phase_dispersion_entropy"] = self.entropy()
        return np.array([out[c] for c in SUMMED])

    def strong(self) -> float:
        """Mean deviation of the cells whose magnitude is over the 80th percentile, the cut bin by its share."""
        total = self.counts.sum()
        above = total - 1 - np.floor(0.8 * (total - 1))
        upper = np.cumsum(self.counts[::-1])[::-1]
        cut = int(np.flatnonzero(upper >= above)[-1])
        inside = above - (upper[cut] - self.counts[cut])
        return (self.away[cut + 1 :].sum() + self.away[cut] * inside / self.counts[cut]) / above

    def entropy(self) -> float:
        """Entropy of the density of phase steps in STEPS bins from the least to the largest."""
        upto = np.interp(np.linspace(self.least, self.most, STEPS + 1), FINE, np.concatenate([[0], np.cumsum(self.total["slopes"])]))
        upto[0], upto[-1] = 0.0, self.total["slopes"].sum()
        density = np.diff(upto) / upto[-1] / ((self.most - self.least) / STEPS) if self.most > self.least else np.zeros(0)
        density = density[density > 1e-9]
        return float(min(max(-(density * np.log2(density + 1e-12)).sum() / 5, 0.0), 1.0))


def high_measures(power: np.ndarray) -> np.ndarray:
    """Share of energy from 4 kHz on, whether the spectrum is cut off, and where, for rows of mean power."""
    power = power + 1e-12
    hz = np.linspace(0, RATE / 2, power.shape[1])
    db = 10 * np.log10(power / power.max(axis=1, keepdims=True))
    rest_max = np.maximum.accumulate(db[:, ::-1], axis=1)[:, ::-1]
    rest_mean = np.cumsum(db[:, ::-1], axis=1)[:, ::-1] / np.arange(db.shape[1], 0, -1)
    k = np.arange(int(1400 / (RATE / 2) * db.shape[1]), db.shape[1] - 6)
    hit = (db[:, k] < -42) & (rest_max[:, k] < -35) & (db[:, k] - db[:, np.maximum(0, k - 12)] < -25) & (rest_mean[:, k] < -45)
    cut = hit.any(axis=1)
    return np.array([power[:, hz >= 4000].sum(axis=1) / power.sum(axis=1), cut.astype(float), np.where(cut, hz[k[hit.argmax(axis=1)]], 0.0)])


def smearing(m: np.ndarray) -> np.ndarray:
    """1 - (mean local peak over mean local valley) / 15, clipped; 0 with fewer than three of either; for rows, or for one."""
    inner, left, right = m[..., 1:-1], m[..., :-2], m[..., 2:]
    up, down = (inner > left) & (inner > right), (inner < left) & (inner < right)
    n_up, n_down = up.sum(axis=-1), down.sum(axis=-1)
    top, base = (inner * up).sum(axis=-1) / np.maximum(n_up, 1), (inner * down).sum(axis=-1) / np.maximum(n_down, 1)
    return np.where((n_up < 3) | (n_down < 3), 0.0, np.clip(1 - top / (base + 1e-8) / 15, 0, 1))


def summed(rows: DataFrame) -> DataFrame:
    """SUMMED of each recording from the sums of its blocks, taken in as they come; those of one block have it already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), *[pa.array([v]) for v in sums.result()]], [KEY, *SUMMED])

        last, sums = None, Sums()
        for key, part in runs(batches, [KEY]):
            if key != last and last is not None:
                yield emit()
                sums = Sums()
            last = key
            for kind, v, w in zip(part.column("kind").to_pylist(), rows_of(part.column("v")), rows_of(part.column("w")), strict=True):
                sums.add(kind, v, w)
        if last is not None:
            yield emit()

    ordered = rows.where(F.col("kind").isin(*ADDED)).select(KEY, "kind", "v", "w").repartition(KEY).sortWithinPartitions(KEY)
    far = ordered.mapInArrow(run, f"{KEY} long, " + ", ".join(f"{c} double" for c in SUMMED))
    return far.unionByName(rows.where("kind = 'sums'").select(KEY, *[F.col("v")[k].alias(c) for k, c in enumerate(SUMMED)]))


def checkerboard(rows: DataFrame) -> DataFrame:
    """Share of the two-dimensional spectrum in its outer corners. Of long recordings, each row over frequency meets over all blocks, so a task holds one row."""
    height = VOCODER // 2 + 1 - int((VOCODER // 2 + 1) * 0.4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            k, series = last[1], np.concatenate(parts)[None]
            sums = corner_sums(np.array([k]), series, height)
            if 0 < k < height - k:
                sums[:2] += corner_sums(np.array([height - k]), series.conj(), height)[:2]
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), *[pa.array([v]) for v in sums]], [KEY, "corner", "total", "wide"])

        last, parts = None, []
        for key, part in runs(batches, [KEY, "key"]):
            if key != last and parts:
                yield emit()
                parts = []
            last = key
            parts += [v + 1j * w for v, w in zip(rows_of(part.column("v")), rows_of(part.column("w")), strict=True)]
        if parts:
            yield emit()

    grid = rows.where("kind = 'grid'").select(KEY, "key", "idx", "v", "w").repartition(KEY, "key").sortWithinPartitions(KEY, "key", "idx")
    far = grid.select(KEY, "key", "v", "w").mapInArrow(run, f"{KEY} long, corner double, total double, wide double")
    near = rows.where("kind = 'corners'").select(KEY, *[F.col("v")[k].alias(c) for k, c in enumerate(("corner", "total", "wide"))])
    got = near.unionByName(far).groupBy(KEY).agg(F.sum("corner").alias("c"), F.sum("total").alias("t"), F.max("wide").alias("wide"))
    share = F.when(F.col("wide") >= 16, F.col("c") / (F.col("t") + 1e-9)).otherwise(0.0)
    return got.select(KEY, share.alias("artifact_checkerboard_ratio"), (share > 0.08).cast("double").alias("artifact_periodic_detected"))


def features(rows: DataFrame, speech: DataFrame | None = None, parity: bool = True) -> DataFrame:
    """recording_id, duration_sec and the 60 features, rounded; `parity` leaves energy_entropy 0, as what is compared with has it."""
    whole = rows.where("kind = 'peak'").groupBy(KEY).agg((F.max("n") / RATE).alias("duration_sec"), F.max(F.col("v")[0]).alias("peak"))
    parts = (acoustic(rows), spectral(rows), prosody(rows, speech), splices(rows), summed(rows), checkerboard(rows))
    for part in parts:
        whole = whole.join(part, KEY, "left")
    loud = F.col("peak") >= GATE
    value = lambda c: F.lit(0.0) if parity and c == "energy_entropy" else F.when(loud, F.round(F.coalesce(F.col(c), F.lit(0.0)), DIGITS[c])).otherwise(0.0)
    return whole.select(KEY, "duration_sec", *[value(c).alias(c) for c in FEATURES])


#: Features of each analyser, in the vector's order.
ANALYSERS = {"acoustic": 24, "spectral": 13, "prosody": 11, "artifacts": 6, "phase": 6}


def feature_maps(table: DataFrame) -> DataFrame:
    """recording_id, duration_sec, and a map of names and values for each analyser."""
    names, out = iter(FEATURES), []
    for analyser, n in ANALYSERS.items():
        out.append(F.create_map(*[x for c in (next(names) for _ in range(n)) for x in (F.lit(c), F.col(c))]).alias(analyser))
    return table.select(KEY, "duration_sec", *out)


def vector(maps: DataFrame) -> Column:
    """The five maps as one vector in fixed order."""
    from .features import vectorize

    names = iter(FEATURES)
    return F.concat(*[vectorize(maps[a], [next(names) for _ in range(n)]) for a, n in ANALYSERS.items()])
