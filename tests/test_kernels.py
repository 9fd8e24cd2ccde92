"""Kernels and the WAV codec against values known beforehand."""

import struct

import numpy as np
import pytest

from tessella.functions import kernels
from tessella.sources import wav

RATE = 16000


def tone(hz, seconds=1.0, amplitude=0.6):
    return amplitude * np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE)


@pytest.mark.parametrize("hz", [110.0, 220.0, 400.0])
def test_pitch_of_a_tone(hz):
    f0, peak = kernels.pitch_track(tone(hz), RATE, 640, 160)
    assert abs(np.median(f0[f0 > 0]) - hz) < 3 and (f0 > 0).mean() > 0.85 and peak.max() <= 1


def test_silence_is_unvoiced():
    f0, peak = kernels.pitch_track(np.zeros(RATE), RATE, 640, 160)
    assert (f0 == 0).all() and (peak == 0).all()


def test_spectrum_of_a_tone_peaks_at_its_bin():
    z = np.abs(kernels.stft(tone(1000), 512, 128))
    assert (z.argmax(1) == round(1000 * 512 / RATE)).all()


def test_short_recordings_are_padded_to_a_frame():
    assert kernels.frames_of(np.ones(3), 8, 4).tolist() == [[1, 1, 1, 0, 0, 0, 0, 0]]
    assert kernels.frames_of(np.arange(16.0), 8, 4).shape == (3, 8)


@pytest.mark.parametrize(("kind", "cutoff", "inside", "outside"), [("low", 1000.0, 100, 6000), ("high", 1000.0, 6000, 100), ("band", (500.0, 2000.0), 1000, 6000)])
def test_filters_pass_and_stop(kind, cutoff, inside, outside):
    sections = kernels.butterworth(4, cutoff, RATE, kind)
    power = lambda hz: np.std(kernels.filter_sections(sections, tone(hz))[RATE // 2 :]) / np.std(tone(hz))
    assert abs(power(inside) - 1) < 0.1 and power(outside) < 0.05


def test_resampling_keeps_a_tone():
    y = kernels.resample(tone(440), RATE, 8000)
    assert len(y) == 8000
    want = 0.6 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    assert np.abs(y - want)[200:-200].max() < 0.02


def test_prediction_of_a_known_recursion():
    rng = np.random.default_rng(0)
    x = np.zeros(20_000)
    for k, e in enumerate(rng.normal(size=20_000)):
        x[k] = 1.2 * x[k - 1] - 0.6 * x[k - 2] + e
    assert kernels.linear_prediction(x, 2) == pytest.approx([1, -1.2, 0.6], abs=0.03)


def test_peaks_obey_height_distance_and_prominence():
    y = np.array([0, 5, 0, 4, 0, 0, 0, 3, 2.9, 3, 0.0])
    assert kernels.find_peaks(y, 1, 1, 1).tolist() == [1, 3, 7, 9] or kernels.find_peaks(y, 1, 1, 1).tolist() == [1, 3]
    assert kernels.find_peaks(y, 4.5, 1, 1).tolist() == [1]
    assert kernels.find_peaks(y, 1, 4, 1)[0] == 1 and 3 not in kernels.find_peaks(y, 1, 4, 1)


def test_residual_network_ends_between_zero_and_one():
    rng = np.random.default_rng(0)
    layers = {}
    for name, (a, b) in {"in": (60, 8), "block0.a": (8, 8), "block0.b": (8, 8), "mid": (8, 4), "out": (4, 1)}.items():
        layers |= {f"{name}.weight": rng.normal(size=(b, a)), f"{name}.bias": np.zeros(b), f"{name}.scale": np.ones(b), f"{name}.shift": np.zeros(b)}
    p = kernels.residual_network(rng.normal(size=(5, 60)), layers)
    assert p.shape == (5,) and ((p > 0) & (p < 1)).all()


def test_wav_round_trip_and_channels():
    x = np.stack([np.full(1000, 0.4), np.full(1000, 0.8)], axis=1)
    got, rate, bits = wav.decode(wav.encode(x, 44100))
    assert (rate, bits, got.shape) == (44100, 16, (1000, 2))
    assert got.mean(1) == pytest.approx(np.full(1000, 0.6), abs=1e-4)


@pytest.mark.parametrize(("tag", "bits", "body", "want"), [
    (1, 8, bytes([0, 128, 255]), [-1, 0, 127 / 128]), (1, 24, b"\x00\x00\x40\x00\x00\xc0", [0.5, -0.5]), (1, 32, struct.pack("<i", -(1 << 30)), [-0.5]),
    (3, 32, struct.pack("<f", 1.5), [1.5]), (3, 64, struct.pack("<d", -0.25), [-0.25]),
])
def test_wav_encodings(tag, bits, body, want):
    form = struct.pack("<HHIIHH", tag, 1, 8000, 8000 * bits // 8, bits // 8, bits)
    data = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body
    x, rate, got = wav.decode(data)
    assert x[:, 0].tolist() == pytest.approx(want) and (rate, got) == (8000, bits)


@pytest.mark.parametrize("data", [b"", b"not a wav", b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0WAVEfmt "])
def test_bad_wav_is_an_error(data):
    with pytest.raises((ValueError, struct.error)):
        wav.decode(data)


def test_folder_source(spark, tmp_path):
    (tmp_path / "human").mkdir()
    (tmp_path / "human" / "a.wav").write_bytes(wav.encode(tone(220, 0.01), RATE))
    (tmp_path / "human" / "b.WAV").write_bytes(b"broken")
    (tmp_path / "human" / "c.txt").write_bytes(b"other")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in wav.read_folder(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"a.wav", "b.WAV"}
    assert (rows["a.wav"].label, rows["a.wav"].sample_rate, rows["a.wav"].n, rows["a.wav"].error) == ("human", RATE, 160, None)
    assert rows["b.WAV"].n == 0 and rows["b.WAV"].error
    assert wav.to_samples(wav.read_folder(spark, f"file://{tmp_path}")).count() == 160
