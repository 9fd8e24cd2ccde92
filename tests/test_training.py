"""Network, calibration, parameter store, embeddings and verdicts."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import kernels
from tessella.operators import analysis, blocks, embedding, training
from tessella.plans import recordings
from tessella.schema import FEATURES
from tessella.sources import store, wav


def small(seed=0):
    return training.new_network(inputs=5, hidden=6, blocks=2, mid=4, seed=seed)


def labelled(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 5))
    return x, ((x[:, 0] * x[:, 1] + x[:, 2] > 0) ^ (rng.random(n) < 0.05)).astype(int)


def test_gradient_equals_differences():
    p, (x, y) = small(), labelled(20)
    loss, right, g = training.loss_and_gradient(p, x, y)
    assert 0 <= right <= 20 and set(g) == set(p)
    v, e = training.flat(p), 1e-6
    for k in np.random.default_rng(1).choice(len(v), 60, replace=False):
        d = np.zeros_like(v)
        d[k] = e
        up, down = (training.loss_and_gradient(training.shaped(v + s * d, p), x, y)[0] for s in (1, -1))
        assert (up - down) / (2 * e) == pytest.approx(training.flat(g)[k], abs=1e-5)


def test_forward_equals_the_kernel():
    p, (x, _) = small(), labelled(30)
    assert np.allclose(1 / (1 + np.exp(-training.forward(p, x)[0])), kernels.residual_network(x, p))


def one_node(x, y, source, start, epochs, rate, decay=1e-4):
    """The same fit over arrays."""
    v, first, second, losses = training.flat(start), 0.0, 0.0, []
    for epoch in range(epochs):
        pace = rate * (1 + math.cos(math.pi * epoch / epochs)) / 2
        loss, _, g = training.loss_and_gradient(training.shaped(v, start), x[~source], y[~source])
        g = training.flat(g) / (~source).sum()
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        v = v - pace * decay * v - pace * (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        check = training.loss_and_gradient(training.shaped(v, start), x[source], y[source])[0] / source.sum()
        losses.append((loss / (~source).sum(), check, v))
    return losses


def test_training_equals_one_node_and_keeps_the_best(spark):
    x, y = labelled()
    rows = spark.createDataFrame([(k // 3, v.tolist(), int(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "source long, features array<double>, label int").repartition(5)
    out = {r.source for r in rows.where(training.held_out(F.col("source"))).select("source").distinct().collect()}
    held = np.array([k // 3 in out for k in range(len(x))])
    fit = training.train(rows, small(), epochs=12, rate=0.02)
    losses = one_node(x, y, held, small(), 12, 0.02)
    assert [(h["train_loss"], h["val_loss"]) for h in fit.history] == [pytest.approx((a, b)) for a, b, _ in losses]
    assert fit.history[-1]["train_loss"] < 0.9 * fit.history[0]["train_loss"]
    assert np.allclose(training.flat(fit.parameters), min(losses, key=lambda r: r[1])[2])
    assert {(h["n_train"], h["n_val"]) for h in fit.history} == {(int((~held).sum()), int(held.sum()))}
    got = {r.recording_id: r.logit for r in training.predict(rows.withColumn("recording_id", F.monotonically_increasing_id()), fit.parameters).collect()}
    assert len(got) == len(x)
    batched = training.train(rows, small(), epochs=3, rate=0.02, batches=4)
    assert batched.history[0]["n_train"] == (~held).sum() and batched.history[-1]["train_loss"] < batched.history[0]["train_loss"]


def test_training_without_rows(spark):
    none = spark.createDataFrame([], "source long, features array<double>, label int")
    fit = training.train(none, small(), epochs=2)
    assert np.allclose(training.flat(fit.parameters), training.flat(small())) and fit.history[1]["n_train"] == 0


def test_platt_fit_equals_a_local_one(spark):
    rng = np.random.default_rng(3)
    s = rng.random(2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(9 * s - 4)))).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, label int")
    a, b = training.fit_platt(rows)
    p = 1 / (1 + np.exp(-(a * s + b)))
    assert abs((p - y).sum()) < 1e-6 and abs(((p - y) * s).sum() + a) < 1e-6  # both slopes of the penalised loss are 0
    assert training.usable_platt(a, b) == ((a, b) if 8 <= a <= 18 else (10.0, -5.0))
    assert training.usable_platt(3.0, 1.0) == (10.0, -5.0)
    assert training.fit_platt(rows.limit(0)) == (0.0, 0.0)


def test_store_keeps_versions_and_passes_over_damage(spark, tmp_path):
    root, x = f"file://{tmp_path}/parameters", labelled(10)[0]
    assert store.load(spark, root) is None
    one, two = small(1), small(2)
    assert store.save(spark, root, one) == 1 and store.save(spark, root, two) == 2
    version, back = store.load(spark, root)
    assert version == 2 and all(np.array_equal(back[k], two[k]) for k in two)
    assert np.array_equal(training.forward(back, x)[0], training.forward(two, x)[0])
    table = store.parameter_table(spark, two)
    assert table.count() == training.flat(two).size and table.agg({"value": "sum"}).first()[0] == pytest.approx(training.flat(two).sum())
    for f in (tmp_path / "parameters" / "version=2").glob("part-*"):
        f.write_bytes(f.read_bytes()[:-40])
    assert store.load(spark, root)[0] == 1
    assert store.save(spark, root, two) == 3
    rows = spark.read.parquet(f"{root}/version=3").where("name <> 'out.bias'").collect()
    spark.createDataFrame(rows, "name string, shape array<long>, values array<double>, digest string").write.parquet(f"{root}/version=4")  # a row is missing
    changed = [(r.name, r.shape, [v + (r.name == "in.bias") for v in r["values"]], r.digest) for r in spark.read.parquet(f"{root}/version=3").collect()]
    spark.createDataFrame(changed, "name string, shape array<long>, values array<double>, digest string").write.parquet(f"{root}/version=5")  # other values
    assert store.versions(spark, root) == [1, 2, 3, 4, 5] and store.load(spark, root)[0] == 3


@pytest.mark.parametrize("size", [1280, 20480])
def test_embeddings_equal_plain_ones(spark, size):
    rng = np.random.default_rng(4)
    raw = {k: rng.integers(90, 170, n).astype(np.uint8) for k, n in enumerate([3, 1023, 1024, 5000, 21000])}
    contents = spark.createDataFrame([(k, v.tobytes()) for k, v in raw.items()], "recording_id long, content binary")
    got = {}
    for r in embedding.voice_embeddings(blocks.pcm_blocks(contents, size, 0, embedding.FFT), size).collect():
        got.setdefault(r.recording_id, np.zeros(128))[r.j] = r.value
    w = np.random.RandomState(1337).randn(160, 128).astype(np.float32) / np.float32(np.sqrt(160))
    for k, v in raw.items():
        x = (v.astype(float) - 128) / 128
        expected = np.ones(128) / math.sqrt(128)
        if len(x) >= 1024:
            m = np.array([np.abs(np.fft.rfft(x[a : a + 512] * np.hanning(512))) for a in range(0, len(x) - 511, 160)])
            e = np.log(np.maximum(m @ embedding.mel_weights().T, 1e-5))
            e = np.concatenate([e.mean(axis=0), e.std(axis=0), np.percentile(e, 25, axis=0), np.percentile(e, 75, axis=0)]) @ w.astype(float)
            expected = e / np.linalg.norm(e)
        assert np.allclose(got[k], expected, atol=1e-9)


def test_verdicts_from_features(spark):
    def table(**changes):
        base = dict.fromkeys(FEATURES, 0.0) | {"pitch_voiced_fraction": 0.7, "pitch_mean_f0": 140.0, "jitter_local_pct": 0.8, "shimmer_local_pct": 2.5, "hnr_mean_db": 15.0, "vocal_tract_length_cm": 17.0, "spectral_flux_mean": 0.1, "phase_if_clustering": 0.7,
                                               "prosody_syllable_count": 12.0, "prosody_f0_range_semitones": 6.0, "prosody_npvi": 55.0}
        return base | changes

    cases = [table(), table(artifact_periodic_detected=1.0), table(artifact_splice_points=4.0), table(prosody_is_monotone=1.0, prosody_f0_range_semitones=0.5), table(pitch_voiced_fraction=0.01), table(has_artificial_cutoff=1.0)]
    rows = spark.createDataFrame([(k, 4.0, *c.values()) for k, c in enumerate(cases)], ["recording_id", "duration_sec", *FEATURES])
    got = {r.recording_id: r for r in recordings.verdicts(rows).collect()}
    assert got[0].verdict == "REAL" and got[0].ml_detector == 0.008 and got[0].risk_level == "LOW"
    assert all(got[k].verdict == "SYNTHETIC" and got[k].ml_detector == 0.94 and got[k].risk_level in ("HIGH", "CRITICAL") for k in (1, 2, 3, 5))
    assert got[4].verdict == "NO_SPEECH" and got[4].probability == 0 and got[4].action == "AWAIT_CALLER_SPEECH"
    assert got[5].spectral == 0.4 and "spectral" in got[5].factors
    p = spark.createDataFrame([(1, 0.99), (0, 0.001)], "recording_id long, probability double")
    got = {r.recording_id: r for r in recordings.verdicts(rows, p).collect()}
    assert (got[1].ml_detector, got[0].ml_detector) == (0.99, 0.001)


def test_augmented_recordings_repeat(spark):
    rows = spark.createDataFrame([(7, k, bytes(range(100, 160))) for k in range(3)] + [(8, 1, None)], "source long, kind int, content binary")
    change = lambda: {(r.source, r.kind): r.c for r in rows.select("source", "kind", blocks.augmented("content", "kind", "source").alias("c")).collect()}
    first = change()
    assert first == change() and first[7, 0] == bytes(range(100, 160)) and first[7, 1] != first[7, 2] and first[8, 1] is None


def test_analysed_table_deletes_its_frames(spark, tmp_path):
    contents = spark.createDataFrame([(1, bytes([100, 150] * 600))], "recording_id long, content binary")
    got = recordings.analysed(contents).collect()
    assert len(got) == 1 and got[0].duration_sec == 1200 / analysis.RATE


@pytest.mark.parametrize("cut", [20, 24, 30, 35])
def test_wav_with_a_short_format_is_an_error_of_the_file(spark, cut):
    whole = wav.encode(np.zeros(10), 16000)
    extensible = whole[:12] + b"fmt " + struct.pack("<IHHIIHH", 16, 0xFFFE, 1, 16000, 32000, 2, 16)
    rows = spark.createDataFrame([("a/b.wav", whole[:cut]), ("a/c.wav", extensible[:cut] if cut > 24 else extensible), ("a/d.wav", whole)], "path string, content binary")
    got = {r.path: r for r in wav.decode_column(rows).collect()}
    assert got["a/b.wav"].error and got["a/c.wav"].error and got["a/d.wav"].error is None and got["a/d.wav"].n == 10


def test_error_function_is_worked_out_for_whole_arrays():
    """Equal to the library's to the last places, also beyond the table and at its places."""
    x = np.concatenate([np.linspace(-8, 8, 20001), np.arange(-384, 385) / 64, [1e300, -1e300, 0.0]])
    assert np.abs(kernels.erf(x) - [math.erf(v) for v in x]).max() < 4e-16


def test_training_rows_are_measured_where_their_recordings_are(spark, tmp_path):
    """Copies are made within the task that measures them, equal to copies in rows; recordings over a block are copied and cut, and each labelled one has three rows."""
    rng = np.random.default_rng(9)
    texts = [(k, "".join(map(chr, rng.integers(32, 127, n).tolist()))) for k, n in enumerate((900, 3000, 5000, 700))] + [(4, None), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in (0, 1, 2, 4, 5, 5)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    read = lambda df: sorted((r.source, r.label, tuple(r.features)) for r in df.collect())
    near = read(recordings.training_rows(spark, f"file://{tmp_path}", f"file://{tmp_path}/a"))
    far = read(recordings.training_rows(spark, f"file://{tmp_path}", f"file://{tmp_path}/b", size=2560))
    assert [(s, y) for s, y, _ in near] == [(k, k % 2) for k in (0, 1, 2) for _ in range(3)] == [(s, y) for s, y, _ in far]
    kinds = spark.createDataFrame([(3 * k + j, k, j, texts[k][1].encode()) for k in range(3) for j in range(3)], "recording_id long, source long, kind int, content binary")
    table = recordings.analysed(kinds.select("recording_id", blocks.augmented("content", "kind", "source").alias("content")))
    v = recordings.features.normalize(F.array(*FEATURES), *recordings.features.baseline(list(FEATURES)))
    assert [f for _, _, f in near] == [f for _, _, f in sorted((r.recording_id // 3, 0, tuple(r.v)) for r in table.select("recording_id", v.alias("v")).collect())]
    assert all(np.allclose(a[2], b[2], atol=0.05) for a, b in zip(near, far, strict=True))
