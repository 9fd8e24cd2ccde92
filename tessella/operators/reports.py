"""What leaves the cascade: summaries, alert lines, metadata of arrays, archive copies and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples that come with the service.
SAMPLES = [
    ("sample_synthetic_ai_vocoder", "sample_synthetic_ai_vocoder.wav", True), ("sample_human_natural", "sample_human_natural.wav", False),
    ("sample_synthetic_tts", "sample_synthetic_tts.wav", True), ("sample_human_call", "sample_human_call.wav", False),
]


def risk_line(verdict: Column, risk_level: Column, probability: Column, confidence: Column) -> Column:
    return F.format_string("[%s] | Risk Level: [%s] | AI Probability: %.1f%% | Confidence: %.1f%%", verdict, risk_level, probability * 100, confidence * 100)


def console_line(verdict: Column, risk: Column, action: Column, factors: Column) -> Column:
    """The line of an alert, with its first three factors."""
    named = F.when(F.size(factors) > 0, F.concat(F.lit(" | Factors: "), F.array_join(F.slice(factors, 1, 3), ", "))).otherwise("")
    return F.concat(F.format_string("%s (%.1f/100) %s", verdict, risk, action), named)


def array_metadata(rows: DataFrame, samples: str, rate: int, channels: int = 1) -> DataFrame:
    """Metadata of arrays of 32-bit samples."""
    n = F.size(samples).cast("long")
    return rows.select(
        "recording_id", F.lit(rate).alias("sample_rate"), F.lit(channels).alias("channels"), F.lit(32).alias("bit_depth"), F.lit(rate * channels * 32 / 1000).alias("bitrate_kbps"),
        n.alias("num_samples"), (n / (rate * channels)).alias("duration_sec"), (4 * n).alias("n_bytes"),
    )


def extension(path: Column) -> Column:
    """From the last dot of the file name, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    """The last part of a path, whatever kind of slashes it has."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def archive_name(key: Column, path: Column) -> Column:
    return F.concat(key, F.lit("_forensic"), extension(path))


def archive(rows: DataFrame, folder: str) -> DataFrame:
    """Write (audio_id, path, content) byte for byte under archive names, with hash and size; the records, read back."""
    record = rows.select("audio_id", archive_name(F.col("audio_id"), F.col("path")).alias("archived_as"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"), "content")
    record.write.mode("append").parquet(folder)
    return rows.sparkSession.read.schema(record.schema).parquet(folder)


# The lines of the five analysers' summaries, and what stands for no indicator. A % 100 column is a share in percent.
SUMMARIES = {
    "acoustic": ("Acoustic Analysis", "None (Natural Acoustic Baseline)", [
        ("Pitch (F0): Mean %.1f Hz | Std: %.1f Hz | Voiced: %.1f%%", ["pitch_mean_f0", "pitch_std_f0", "pitch_voiced_fraction * 100"]),
        ("Perturbation: Jitter %.2f%% | Shimmer %.2f%% (%.2f dB)", ["jitter_local_pct", "shimmer_local_pct", "shimmer_db"]),
        ("Formants: F1=%.0fHz, F2=%.0fHz, F3=%.0fHz | VTL: %.1f cm", ["formant_f1_mean", "formant_f2_mean", "formant_f3_mean", "vocal_tract_length_cm"]),
        ("Voice Quality: HNR %.1f dB | CPP %.1f dB | ZCR: %.3f", ["hnr_mean_db", "cpp_mean_db", "zcr_mean"]),
    ]),
    "spectral": ("Spectral Analysis", "None (Normal Spectral Profile)", [
        ("Moments: Centroid %.0f Hz (±%.0fHz) | Spread %.0f Hz", ["spectral_centroid_mean", "spectral_centroid_std", "spectral_spread_mean"]),
        ("Dynamics: Flux %.3f | Rolloff %.0f Hz | Flatness %.4f", ["spectral_flux_mean", "spectral_rolloff_mean", "spectral_flatness_mean"]),
        ("High-Frequency: Artificial Cutoff = %s (Cutoff: %s) | HF Ratio: %.3f", ["if(has_artificial_cutoff > 0.5, 'True', 'False')", "if(cutoff_frequency_hz > 0, string(cutoff_frequency_hz), 'None')", "spectral_hf_energy_ratio"]),
    ]),
    "prosody": ("Prosody Analysis", "None (Natural Conversational Prosody)", [
        ("Rhythm: %.1f syll/sec (%d syllables) | Articulation Rate: %.1f syll/sec", ["prosody_speaking_rate", "bigint(prosody_syllable_count)", "prosody_articulation_rate"]),
        ("Pauses: %d pauses (Mean: %.2fs) | nPVI: %.1f", ["bigint(prosody_pause_count)", "prosody_mean_pause_sec", "prosody_npvi"]),
        ("Intonation: Range %.1f semitones | Monotone: %s | Turns: %d", ["prosody_f0_range_semitones", "if(prosody_is_monotone > 0.5, 'True', 'False')", "bigint(prosody_direction_changes)"]),
    ]),
    "synthesis_artifacts": ("Synthesis Artifacts", "None (Clean Phonation Waveform)", [
        ("Vocoder Check: Periodic Pattern = %s | Smearing: %.3f", ["if(artifact_periodic_detected > 0.5, 'True', 'False')", "artifact_harmonic_smearing"]),
        ("Splicing Check: Splices Detected = %d | Max Step: %.1f dB", ["bigint(artifact_splice_points)", "artifact_max_energy_jump_db"]),
    ]),
    "phase": ("Phase Analysis", "None (Coherent Phonation Phase)", [
        ("IF Dynamics: Deviation = %.3f | Clustering = %.3f", ["phase_if_mean_deviation", "phase_if_clustering"]),
        ("Group Delay: MGD Prominence = %.3f | Phase Dispersion Entropy = %.3f", ["phase_mgd_peak_prominence", "phase_dispersion_entropy"]),
    ]),
}


def summary(analyser: str, score: Column, confidence: Column, indicators: Column) -> Column:
    """An analyser's findings as text, from the columns of its features."""
    title, none, lines = SUMMARIES[analyser]
    parts = [F.lit(f"=== {title} Summary ==="), F.format_string("• Anomaly Score: %.3f | Confidence: %.2f", score, confidence)]
    parts += [F.format_string(f"• {line}", *map(F.expr, columns)) for line, columns in lines]
    parts.append(F.concat(F.lit("• Indicators: "), F.when(F.size(indicators) > 0, F.array_join(indicators, ", ")).otherwise(none)))
    return F.concat_ws("\n", *parts)
