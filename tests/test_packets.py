"""Packets of bytes, chunks of JSON, and analysers' summaries."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import reports
from tessella.plans import recordings
from tessella.schema import FEATURES
from tessella.streaming import packets


def test_packets_are_decoded_by_their_own_encoding(spark):
    x = np.array([0.0, 0.5, -1.0, 0.999])
    rows = [("a", k, x.astype("<f4").tobytes() if k == "float32" else x.tobytes() if k == "float64" else (x * f + 128 * (t == "u1")).astype(t).tobytes(), k) for k, (t, f) in packets.ENCODINGS.items()]
    rows += [("a", "odd", b"\x00\x40\x01", "int16"), ("a", "none", None, "int16"), ("a", "unknown", b"1234", "mp3"), ("a", "nan", np.array([np.nan, np.inf, 0.25], "<f4").tobytes(), "float32")]
    got = {r.k: r.samples for r in packets.decode_packets(spark.createDataFrame(rows, "session_id string, k string, payload binary, encoding string")).collect()}
    for k in packets.ENCODINGS:
        assert np.allclose(got[k], x, atol=1e-2 if k == "uint8" else 1e-4)
    assert got["odd"] == [0.5] and got["none"] == [] and got["unknown"] is None and got["nan"] == [0.0, 0.0, 0.25]
    # four 16-bit samples are as long as two of 32 bits: only the encoding tells
    sent = spark.range(1).select(packets.encoded(F.array(*map(F.lit, [0.5, -0.5, 1.0, 2.0])), F.lit("int16")).alias("payload"), F.lit("int16").alias("encoding"))
    assert np.allclose(packets.decode_packets(sent).first().samples, [0.5, -0.5, 1.0, 1.0], atol=1e-4)


def test_chunks_of_json(spark):
    rows = spark.createDataFrame([(1, '{"samples": [0.1, -0.2], "sample_rate": 8000, "scenario": "standard_support"}'), (2, '{"samples": []}'), (3, "no json"), (4, None)], "k int, body string")
    got = {r.k: (r.samples, r.sample_rate, r.scenario) for r in packets.parse_chunks(rows).collect()}
    assert got == {1: ([0.1, -0.2], 8000, "standard_support"), 2: ([], 16000, None), 3: (None, 16000, None), 4: (None, 16000, None)}


def test_summaries(spark):
    values = dict.fromkeys(FEATURES, 0.0) | {"pitch_mean_f0": 140.26, "pitch_voiced_fraction": 0.655, "has_artificial_cutoff": 1.0, "cutoff_frequency_hz": 5000.0, "prosody_syllable_count": 12.0, "artifact_splice_points": 3.0, "phase_if_clustering": 0.75}
    row = spark.createDataFrame([(1, 4.0, *values.values())], ["recording_id", "duration_sec", *FEATURES])
    text = row.select(*[reports.summary(n, s, c, F.array().cast("array<string>")).alias(n) for n, (s, c) in recordings.analyser_scores().items()]).first()
    assert text.acoustic.split("\n")[2] == "• Pitch (F0): Mean 140.3 Hz | Std: 0.0 Hz | Voiced: 65.5%" and text.acoustic.endswith("Indicators: None (Natural Acoustic Baseline)")
    assert "Artificial Cutoff = True (Cutoff: 5000.0)" in text.spectral and "(12 syllables)" in text.prosody and "Splices Detected = 3" in text.synthesis_artifacts and "Clustering = 0.750" in text.phase
    told = row.select(reports.summary("phase", F.lit(0.5), F.lit(0.9), F.array(F.lit("a"), F.lit("b"))).alias("t")).first().t
    assert told.startswith("=== Phase Analysis Summary ===\n• Anomaly Score: 0.500 | Confidence: 0.90\n") and told.endswith("• Indicators: a, b")


def test_live_verdicts_of_windows(spark):
    """Windows that pass the gate are analysed as recordings of their own; the others are NO_SPEECH."""
    rng = np.random.default_rng(0)
    t = np.arange(16000) / 16000
    f = 130 + 15 * np.sin(2 * np.pi * 1.5 * t)
    voice = 0.5 * sum(a * np.sin(2 * np.pi * h * np.cumsum(f) / 16000) for h, a in ((1, 0.5), (2, 0.3), (3, 0.2), (5, 0.15))) + 0.01 * rng.standard_normal(16000)
    level = lambda x: (float(np.abs(x).max()), float(np.sqrt((x * x).mean())))
    rows = [("a", 0, 0, voice.tolist(), *level(voice), 1.0, None), ("a", 1, 8000, (0.001 * voice).tolist(), *level(0.001 * voice), 1.0, 5.0), ("b", 0, 0, voice.tolist(), *level(voice), 0.0, None)]
    windows = spark.createDataFrame(rows, "session_id string, window_no long, start_idx long, samples array<double>, peak double, rms double, speech_ratio double, received_ms double")
    got = {(r.session_id, r.window_no): r for r in recordings.live_verdicts(windows).collect()}
    assert got["a", 0].gate == "pass" and got["a", 0].verdict in ("REAL", "SYNTHETIC") and got["a", 0].ml_detector in (0.008, 0.94)
    alone = recordings.verdicts(recordings.analysed_blocks(recordings.blocks.array_blocks(windows.where("session_id = 'a' AND window_no = 0").select(F.lit(1).alias("recording_id"), "samples"), 20480, 256, 1024))).first()
    assert (got["a", 0].probability, got["a", 0].verdict, got["a", 0].phase) == (alone.probability, alone.verdict, alone.phase)
    assert [(got[k].gate, got[k].verdict, got[k].probability, got[k].factors) for k in (("a", 1), ("b", 0))] == [("silence", "NO_SPEECH", 0.0, []), ("non-speech", "NO_SPEECH", 0.0, [])]
