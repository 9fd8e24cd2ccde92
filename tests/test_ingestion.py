"""Resampling, and ingestion of files as one flow."""

import hashlib
import wave
from io import BytesIO

import numpy as np
import pytest

from tessella.functions.resample import filter_taps, polyphase, reach
from tessella.operators import blocks, ingestion
from tessella.sources import wav

from .test_activity import speech


def plain_resample(x, up, down):
    """Zeros between samples, filtered, every `down`-th kept."""
    h = filter_taps(up, down)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, h)[len(h) // 2 :][: len(wide)][::down]


@pytest.mark.parametrize(("source", "target"), [(48000, 16000), (44100, 16000), (8000, 16000), (16000, 24000), (16000, 16000)])
def test_resampling_equals_its_definition_and_blocks_do_not_matter(spark, source, target):
    g = np.gcd(source, target)
    rng = np.random.default_rng(0)
    signals = {k: rng.standard_normal(n) for k, n in enumerate([1, 50, 999, 3000])}
    whole = {k: polyphase(x, source, target) for k, x in signals.items()}
    for k, x in signals.items():
        assert len(whole[k]) == -(-len(x) * target // source)
        assert np.allclose(whole[k], plain_resample(x, target // g, source // g), atol=1e-9)
    samples = spark.createDataFrame([(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)], "recording_id long, idx long, x double")
    r = reach(source, target)
    got = ingestion.resampled(blocks.sample_blocks(samples, 200, r, r), 200, source, target).collect()
    for k in signals:
        own = sorted((r for r in got if r.recording_id == k), key=lambda r: r.block)
        assert np.allclose(np.concatenate([r.samples for r in own]), whole[k], atol=1e-9)


def test_resampling_keeps_a_tone_and_removes_what_is_too_high():
    t = np.arange(48000) / 48000
    y = polyphase(np.sin(2 * np.pi * 1000 * t), 48000, 16000)
    assert np.allclose(y[100:-100], np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)[100:-100], atol=2e-3)
    assert np.abs(polyphase(np.sin(2 * np.pi * 12000 * t), 48000, 16000)[100:-100]).max() < 1e-2


def test_preprocessing():
    t = np.arange(16000) / 16000
    biased = 0.2 * np.sin(2 * np.pi * 300 * t) + 0.3
    y = ingestion.preprocess(biased, 16000)
    assert abs(y.mean()) < 0.05 and 20 * np.log10(np.sqrt((y * y).mean())) == pytest.approx(-20, abs=0.5)
    assert np.allclose(ingestion.preprocess(np.column_stack([np.full(1000, 0.4), np.full(1000, 0.8)]), 16000), 0, atol=1e-9)
    quiet = ingestion.preprocess(0.001 * np.sin(2 * np.pi * 300 * t), 16000)
    assert np.abs(quiet).max() < 0.0012
    assert len(ingestion.preprocess(speech(48000), 48000)) == 64000 and np.abs(ingestion.preprocess(np.sign(np.sin(2 * np.pi * 50 * t)), 16000)).max() <= 0.95 + 1e-9
    assert len(ingestion.preprocess(np.zeros(0), 16000)) == 0


@pytest.mark.parametrize("n", [0, 7999, 8000, 47999, 48000, 48001, 55999, 56000, 64000, 72000, 100_000])
def test_chunks(n):
    got = ingestion.chunks_of(n, [(0, n, True)])
    assert all(b - a <= 48000 and r == 1.0 and p == (b - a < 48000) for a, b, r, p in got)
    assert [a for a, _, _, _ in got] == [16000 * k for k in range(len(got))]
    assert (len(got) > 0) == (n >= 8000)


def test_ingestion_of_files(spark, tmp_path):
    stereo = BytesIO()
    with wave.open(stereo, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(44100)
        t = np.arange(3 * 44100) / 44100
        w.writeframes((np.column_stack([0.5 * np.sin(2 * np.pi * 440 * t), 0.5 * np.sin(2 * np.pi * 880 * t)]) * 32767).astype("<i2").tobytes())
    files = {1: wav.encode(speech(48000), 48000), 2: stereo.getvalue(), 3: wav.encode(np.zeros(32000), 16000), 4: b"RIFF but no more", 5: b"", 6: None, 7: wav.encode(np.zeros(0), 16000)}
    rows = spark.createDataFrame([(k, f"a/b{k}.WAV", v) for k, v in files.items()], "audio_id long, path string, content binary").repartition(3)
    got = {r.audio_id: r for r in ingestion.ingest(rows, f"file://{tmp_path}/archive").collect()}
    assert set(got) == set(files)
    for k, v in files.items():
        v = v or b""
        assert (got[k].sha256, got[k].md5, got[k].n_bytes) == (hashlib.sha256(v).hexdigest(), hashlib.md5(v).hexdigest(), len(v))
        assert got[k].verified and got[k].archived_as == f"{k}_forensic.wav"
    assert all(got[k].error and got[k].samples is None for k in (4, 5, 6)) and not any(got[k].error for k in (1, 2, 3, 7))
    voice = got[1]
    assert len(voice.samples) == 64000 and voice.speech_sec > 1 and voice.silence_sec > 0.5 and 0.3 < voice.speech_ratio < 0.85 and len(voice.segments) >= 2
    assert len(voice.chunks) == 2 and all(0 < c.speech_ratio <= 1 for c in voice.chunks)
    assert (got[2].channels, got[2].source_rate, len(got[2].samples), got[2].is_clipped) == (2, 44100, 48000, False)
    assert got[3].speech_sec == 0 and got[3].silence_sec == 2 and got[3].peak_dbfs == -100
    assert got[7].source_samples == 0 and got[7].chunks == []


def test_files_are_not_shuffled_and_all_have_their_record(spark, tmp_path):
    """Files without a number or with one number keep a row each, with hashes of their own; rows are cut anywhere."""
    made = [wav.encode(0.2 * np.sin(np.arange(n) / 9), 16000) for n in (0, 900, 150_000, 40, 70_000)]
    rows = [(None, "a/n.wav", made[1]), (1, "a/1.wav", made[2]), (1, "b/1.wav", made[3]), (2, "a/2.wav", made[4]), (3, "a/3.wav", b"no sound"), (4, "a/4.wav", made[0]), (5, "a/5.wav", None)]
    files = spark.createDataFrame(rows, "audio_id long, path string, content binary").coalesce(1)
    out = ingestion.ingest(files, str(tmp_path / "archive"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.path: r for r in out.collect()}
    assert len(got) == len(rows)
    for number, path, content in rows:
        r = got[path]
        assert (r.audio_id, r.sha256, r.n_bytes, r.verified) == (number, hashlib.sha256(content or b"").hexdigest(), len(content or b""), True)
        if content is None or content == b"no sound":
            assert r.error and r.samples is None and r.segments is None and r.chunks is None
        else:
            rate, _, _, n, _, _, _, x, spans, *_, cut, _ = ingestion._record(content)
            assert r.error is None and r.source_samples == n and np.allclose(r.samples, x, atol=1e-12)
            assert [tuple(s) for s in r.segments] == spans and [tuple(c) for c in r.chunks] == cut
