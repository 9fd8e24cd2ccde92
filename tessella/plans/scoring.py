"""The scoring cascade as column expressions: anomaly scores, fusion, calibration, verdict, risk and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import clip, logistic
from ..schema import ACTIONS, CATEGORIES, DEFAULT_SCENARIO, MODALITY_WEIGHTS, SCENARIOS, TOP_CATEGORY, UNCERTAIN_WINDOW

def _points(*rules: tuple[Column, Column]) -> Column:
    """Sum of the points of the rules that hold."""
    out = F.lit(0.0)
    for holds, points in rules:
        out = out + F.when(holds, points).otherwise(0.0)
    return clip(out, 0.0, 1.0)


def scenario(name: Column) -> Column:
    return F.when(name.isin(*SCENARIOS), name).otherwise(F.lit(DEFAULT_SCENARIO))


def threshold(name: Column) -> Column:
    out = F.lit(SCENARIOS[DEFAULT_SCENARIO])
    for key, value in SCENARIOS.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out


def acoustic_anomaly(voiced: Column, f0: Column, jitter: Column, shimmer: Column, hnr: Column, tract_cm: Column, duration: Column) -> tuple[Column, Column]:
    """(score, confidence); too little voice gives 0 and a low confidence."""
    thin = (voiced < 0.15) | (f0 <= 0)
    score = _points(
        (jitter < 0.15, 0.30 * F.least(F.lit(1.0), (0.15 - F.greatest(F.lit(0.0), jitter)) / 0.15 * 1.5)),
        (shimmer < 0.80, 0.30 * F.least(F.lit(1.0), (0.80 - F.greatest(F.lit(0.0), shimmer)) / 0.80 * 1.5)),
        (hnr > 35, 0.20 * F.least(F.lit(1.0), (hnr - 35) / 10)),
        ((tract_cm < 8) | (tract_cm > 26), F.lit(0.16)),
    )
    sure = clip(0.5 + voiced * 0.4 + F.least(F.lit(0.1), duration / 10), 0.0, 1.0)
    return F.when(thin, 0.0).otherwise(score), F.when(thin, F.least(F.lit(0.4), duration / 3)).otherwise(sure)


def spectral_anomaly(has_cutoff: Column, flatness: Column, flux: Column, duration: Column) -> tuple[Column, Column]:
    score = _points((has_cutoff, F.lit(0.40)), (flatness > 0.65, 0.35 * F.least(F.lit(1.0), (flatness - 0.65) / 0.25)), ((flux < 0.003) & (duration > 1.5), F.lit(0.20)))
    return score, clip(0.6 + F.least(F.lit(0.3), duration / 5), 0.0, 1.0)


def prosody_anomaly(syllables: Column, semitones: Column, monotone: Column, npvi: Column, duration: Column) -> tuple[Column, Column]:
    none = (syllables == 0) | (semitones == 0)
    score = _points((monotone & (duration >= 2) & (semitones < 1), F.lit(0.54)), ((duration >= 5) & (syllables >= 10) & (npvi > 0) & (npvi < 2), F.lit(0.32)))
    return F.when(none, 0.0).otherwise(score), F.when(none, 0.0).otherwise(clip(0.5 + F.least(F.lit(0.4), duration / 4), 0.0, 1.0))


def artifact_anomaly(periodic: Column, checkerboard: Column, splices: Column, jump_db: Column, duration: Column) -> tuple[Column, Column]:
    score = _points(
        (periodic, F.lit(0.50)), (~periodic & (checkerboard > 0.12), 0.50 * F.least(F.lit(1.0), (checkerboard - 0.12) / 0.08)),
        ((splices >= 6) & (jump_db > 24), 0.50 * F.least(F.lit(1.0), (splices - 5) * 0.25)),
    )
    return score, clip(0.6 + F.least(F.lit(0.3), duration / 3), 0.0, 1.0)


def phase_anomaly(clustering: Column, entropy: Column, roughness: Column, duration: Column) -> tuple[Column, Column]:
    score = _points(((clustering < 0.08) & (duration > 1.5), 0.60 * (1 - clustering / 0.08)), ((entropy > 0.98) & (roughness > 6), F.lit(0.32)))
    return score, clip(0.6 + F.least(F.lit(0.3), duration / 3), 0.0, 1.0)


def classify(p: Column, checkerboard: Column, cutoff: Column, monotone: Column, semitones: Column, splices: Column, jitter: Column, shimmer: Column) -> Column:
    """A model's probability, raised or lowered by physical evidence."""
    physical = checkerboard | cutoff | (monotone & (semitones < 0.8)) | (splices >= 4) | ((jitter > 0) & (jitter < 0.10) & (shimmer > 0) & (shimmer < 0.50))
    return F.when(physical, F.greatest(p, F.lit(0.94))).otherwise(F.least(p, F.lit(0.008)))


def linear_score(scores: dict[str, Column]) -> Column:
    total = sum(MODALITY_WEIGHTS.values())
    out = F.lit(0.0)
    for name, weight in MODALITY_WEIGHTS.items():
        out = out + scores[name] * (weight / total)
    return out


def fuse(scores: dict[str, Column], impersonation: Column, has_claim: Column, similarity: Column) -> Column:
    """Weighted sum, held near a clear model score, with a penalty for a failed claim."""
    linear, ml = linear_score(scores), scores["ml_detector"]
    held = F.when(ml < 0.25, F.least(linear, F.greatest(ml, linear * 0.1))).when(ml >= 0.70, F.greatest(linear, ml)).otherwise(linear)
    return F.when(impersonation & has_claim, F.least(F.lit(1.0), held + (1 - similarity) * 0.4)).otherwise(held)


def platt_parameters(a: float | None = None, b: float | None = None, center: float = 0.65) -> tuple[float, float]:
    """Slope and offset of the calibration; odd midpoints fall back to the centre."""
    if a is None or b is None:
        return 8.0, -8.0 * center
    slope = min(8.0, max(4.0, a if a > 0 else 8.0))
    middle = -b / a if a > 0 else center
    return slope, b if 0.60 <= middle <= 0.75 else -slope * center


def calibrate(raw: Column, a: float | None = None, b: float | None = None) -> Column:
    slope, offset = platt_parameters(a, b)
    return clip(logistic(slope * raw + offset), 0.0, 1.0)


def agreement(scores: list[Column]) -> Column:
    """Share of the modalities that side with the majority; a tie counts as yes."""
    n = len(scores)
    yes = sum((F.when(s >= 0.5, 1).otherwise(0) for s in scores), F.lit(0))
    return F.when(yes >= n / 2, yes).otherwise(n - yes) / n


def confidence(duration: Column, agreed: Column, modality: Column, consistency: Column, window_range: Column) -> Column:
    base = 0.25 * (clip(duration / 3, 0.1, 1.0) + agreed + modality + clip(consistency, 0.0, 1.0))
    return clip(F.when(window_range > 0.40, base * F.greatest(F.lit(0.5), 1 - (window_range - 0.40))).otherwise(base), 0.05, 0.99)


def category(p: Column) -> Column:
    out = F.lit(TOP_CATEGORY)
    for limit, name in reversed(CATEGORIES):
        out = F.when(p < limit, F.lit(name)).otherwise(out)
    return out


def verdict(p: Column, conf: Column, t: Column, ml: Column, strong_signals: Column, factors: Column, splices: Column) -> Column:
    """The order of the cases is part of the rule."""
    strong = (p >= 0.90) | (ml >= 0.90) | ((p >= t) & ((strong_signals >= 2) | (factors >= 2) | (ml >= 0.85)))
    unclear = ((p >= 0.45) & (p < t)) | ((F.abs(p - t) < UNCERTAIN_WINDOW) & (conf < 0.65))
    return F.when(unclear, "UNCERTAIN").when((splices >= 2) & (p > 0.25) & (p < 0.80), "MANIPULATED").when((p >= t) & strong, "SYNTHETIC").when(p >= t, "UNCERTAIN").otherwise("REAL")


def risk_level(verdict_: Column, p: Column, raw: Column, scenario_: Column) -> Column:
    risk = F.round(p * 100, 1)
    medium = (risk >= 30) | (verdict_ == "UNCERTAIN") | ((scenario_ == "high_value_transaction") & ((risk >= 5) | (raw >= 0.25)))
    return F.when((verdict_ == "SYNTHETIC") & (risk >= 75), "CRITICAL").when(verdict_.isin("SYNTHETIC", "MANIPULATED") | (risk >= 70), "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def action(level: Column) -> Column:
    out = F.lit(ACTIONS["LOW"])
    for name, what in ACTIONS.items():
        out = F.when(level == name, F.lit(what)).otherwise(out)
    return out


def speech_gate(seconds: Column, ratio: Column, rms_db: Column) -> Column:
    return (seconds >= 0.25) & (ratio >= 0.05) & (rms_db > -55)


def no_speech_reason(has_speech: Column, peak: Column, rms_db: Column) -> Column:
    """Why a recording is not scored; null if it is."""
    return F.when(~has_speech & ((peak < 0.005) | (rms_db < -52)), "silence").when(~has_speech, "non-speech")


def stream_gate(has_speech: Column, peak: Column, ratio: Column, rms_db: Column) -> Column:
    """silence, non-speech, or pass for a window of a stream."""
    closed = ~has_speech | (peak < 0.015) | (ratio < 0.10) | (rms_db < -50)
    return F.when(closed & ((peak < 0.01) | (rms_db < -50)), "silence").when(closed, "non-speech").otherwise("pass")


def assess(df, ml: str = "ml_detector"):
    """raw, probability, confidence, category, verdict, risk_level and action for a frame with the columns of `adapters.scores`."""
    names = list(MODALITY_WEIGHTS)
    s = {n: F.col(n) for n in names}
    named = df.withColumn("scenario", scenario(F.col("scenario"))).withColumn("raw", F.round(fuse(s, F.col("impersonation"), F.col("has_claim"), F.col("similarity")), 4))
    strong = sum((F.when(F.col(n) >= 0.55, 1).otherwise(0) for n in names if n != ml), F.lit(0))
    out = named.withColumn("probability", F.round(calibrate(F.col("raw")), 4)).withColumn("agreement", agreement([s[n] for n in names]))
    out = out.withColumn("confidence", F.round(confidence(F.col("duration_sec"), F.col("agreement"), F.col("modality_confidence"), F.col("consistency"), F.col("window_range")), 4))
    out = out.withColumn("category", category(F.col("probability"))).withColumn("verdict", verdict(F.col("probability"), F.col("confidence"), threshold(F.col("scenario")), F.col(ml), strong, F.col("n_factors"), F.col("splice_points")))
    out = out.withColumn("risk_level", risk_level(F.col("verdict"), F.col("probability"), F.col("raw"), F.col("scenario")))
    return out.withColumn("action", action(F.col("risk_level")))
