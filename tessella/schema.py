"""Feature names in order with their baseline mean and deviation, scenarios, verdicts and actions."""

from __future__ import annotations

#: name: (mean, deviation)
FEATURES: dict[str, tuple[float, float]] = {
    "pitch_mean_f0": (150.0, 45.0), "pitch_std_f0": (20.0, 12.0), "pitch_min_f0": (90.0, 30.0), "pitch_max_f0": (240.0, 60.0),
    "pitch_voiced_fraction": (0.65, 0.2), "jitter_local_pct": (0.75, 0.4), "jitter_rap_pct": (0.35, 0.2), "jitter_ppq5_pct": (0.4, 0.2),
    "shimmer_local_pct": (2.5, 1.2), "shimmer_apq3_pct": (1.2, 0.6), "shimmer_apq5_pct": (1.5, 0.7), "shimmer_db": (0.25, 0.15),
    "formant_f1_mean": (550.0, 150.0), "formant_f2_mean": (1500.0, 350.0), "formant_f3_mean": (2500.0, 400.0), "formant_f4_mean": (3500.0, 450.0),
    "formant_dispersion": (1000.0, 150.0), "vocal_tract_length_cm": (16.5, 2.0), "hnr_mean_db": (18.0, 6.0), "hnr_std_db": (4.0, 2.0),
    "cpp_mean_db": (12.0, 4.0), "cpp_std_db": (2.5, 1.0), "zcr_mean": (0.1, 0.05), "energy_entropy": (3.5, 0.8),
    "spectral_centroid_mean": (1800.0, 600.0), "spectral_centroid_std": (600.0, 250.0), "spectral_spread_mean": (1200.0, 300.0),
    "spectral_skewness_mean": (1.5, 0.8), "spectral_kurtosis_mean": (4.5, 2.0), "spectral_flux_mean": (0.05, 0.03), "spectral_flux_std": (0.03, 0.02),
    "spectral_rolloff_mean": (3200.0, 800.0), "spectral_flatness_mean": (0.05, 0.04), "spectral_crest_factor_mean": (5.0, 2.0),
    "spectral_hf_energy_ratio": (0.15, 0.08), "has_artificial_cutoff": (0.0, 0.5), "cutoff_frequency_hz": (7000.0, 1500.0),
    "prosody_speaking_rate": (4.2, 1.2), "prosody_articulation_rate": (4.8, 1.1), "prosody_syllable_count": (15.0, 8.0), "prosody_pause_count": (2.0, 1.5),
    "prosody_mean_pause_sec": (0.35, 0.2), "prosody_npvi": (55.0, 15.0), "prosody_rpvi": (65.0, 20.0), "prosody_f0_range_semitones": (6.5, 2.5),
    "prosody_pitch_slope_variance": (1200.0, 600.0), "prosody_is_monotone": (0.0, 0.3), "prosody_direction_changes": (8.0, 4.0),
    "artifact_checkerboard_ratio": (0.015, 0.02), "artifact_periodic_detected": (0.0, 0.3), "artifact_harmonic_smearing": (0.15, 0.15),
    "artifact_splice_points": (0.0, 1.0), "artifact_max_energy_jump_db": (4.0, 3.0), "artifact_max_phase_jump_rad": (0.4, 0.3),
    "phase_if_mean_deviation": (0.08, 0.04), "phase_if_variance": (0.005, 0.003), "phase_if_clustering": (0.7, 0.18),
    "phase_mgd_peak_prominence": (0.6, 0.2), "phase_dispersion_entropy": (0.5, 0.18), "phase_roughness": (1.2, 0.6),
}
FEATURE_NAMES = list(FEATURES)

#: Decimal places to which each feature is rounded; six where none is given.
DIGITS = dict.fromkeys(FEATURES, 6) | {
    "pitch_mean_f0": 2, "pitch_std_f0": 2, "pitch_min_f0": 2, "pitch_max_f0": 2, "pitch_voiced_fraction": 3, "jitter_local_pct": 3, "jitter_rap_pct": 3, "jitter_ppq5_pct": 3,
    "shimmer_local_pct": 3, "shimmer_apq3_pct": 3, "shimmer_apq5_pct": 3, "shimmer_db": 3, "formant_f1_mean": 2, "formant_f2_mean": 2, "formant_f3_mean": 2, "formant_f4_mean": 2,
    "formant_dispersion": 2, "vocal_tract_length_cm": 2, "hnr_mean_db": 2, "hnr_std_db": 2, "cpp_mean_db": 2, "cpp_std_db": 2, "zcr_mean": 4, "energy_entropy": 3,
    "spectral_centroid_mean": 1, "spectral_centroid_std": 1, "spectral_spread_mean": 1, "spectral_skewness_mean": 3, "spectral_kurtosis_mean": 3, "spectral_flux_mean": 4, "spectral_flux_std": 4,
    "spectral_rolloff_mean": 1, "spectral_flatness_mean": 4, "spectral_crest_factor_mean": 2, "spectral_hf_energy_ratio": 4, "has_artificial_cutoff": 0, "cutoff_frequency_hz": 1,
    "prosody_speaking_rate": 2, "prosody_articulation_rate": 2, "prosody_syllable_count": 0, "prosody_pause_count": 0, "prosody_mean_pause_sec": 3, "prosody_npvi": 2, "prosody_rpvi": 2,
    "prosody_f0_range_semitones": 2, "prosody_pitch_slope_variance": 2, "prosody_is_monotone": 0, "prosody_direction_changes": 0, "artifact_splice_points": 0, "artifact_max_energy_jump_db": 2,
    "artifact_max_phase_jump_rad": 3, "phase_if_mean_deviation": 4, "phase_if_variance": 5, "phase_if_clustering": 3, "phase_mgd_peak_prominence": 3, "phase_dispersion_entropy": 3, "phase_roughness": 3,
}

#: Score threshold and half-width of the uncertain zone of each scenario.
SCENARIOS = {"high_value_transaction": 0.70, "confidential_disclosure": 0.75, "standard_support": 0.80, "general_telephony": 0.75}
DEFAULT_SCENARIO, UNCERTAIN_WINDOW = "general_telephony", 0.10
MODALITY_WEIGHTS = {"ml_detector": 0.75, "synthesis_artifacts": 0.08, "acoustic": 0.07, "spectral": 0.04, "prosody": 0.04, "phase": 0.02}
ACTIONS = {
    "CRITICAL": "BLOCK_TRANSACTION_AND_ESCALATE_TO_FRAUD_CELL", "HIGH": "TRIGGER_STEP_UP_MFA_AND_VOICE_CALLBACK",
    "MEDIUM": "ADVISE_SECONDARY_VERIFICATION", "LOW": "AUTHORIZE_STANDARD_PROCESSING",
}
CATEGORIES = [(0.20, "Clearly Human"), (0.40, "Mostly Human"), (0.60, "Ambiguous / Inconclusive"), (0.80, "Likely AI"), (0.95, "Strong AI Evidence")]
TOP_CATEGORY = "Extremely Strong AI Evidence"
CHANNELS = ["console", "in_app", "webhook"]
