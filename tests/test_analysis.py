"""The five analysers, filters over blocks and peaks against plain restatements over whole recordings."""

import math

import numpy as np
import pytest

from tessella.functions import kernels, peaks
from tessella.operators import analysis, blocks, levels, recurrence, whole
from tessella.schema import DIGITS, FEATURES

RATE = 16000


def slices(x, size, hop):
    return [x[k : k + size] for k in range(0, len(x) - size + 1, hop)]


def spread_of(values):
    mean = np.mean(values)
    if len(values) < 5 or mean <= 0:
        return 0.0, 0.0, 0.0
    around = lambda k: [abs(values[i] - np.mean(values[i - k : i + k + 1])) for i in range(k, len(values) - k)]
    return tuple(100 * np.mean(t) / mean if len(t) else 0.0 for t in (np.abs(np.diff(values)), around(1), around(2)))


def plain_acoustic(x):
    f0, lags, amps, hnr, cpp, zcr, energy, hz = [], [], [], [], [], [], [], [[], [], [], []]
    y = np.append(x[0], x[1:] - 0.97 * x[:-1])
    for frame, lifted in zip(slices(x, 480, 160), slices(y, 480, 160), strict=True):
        w = frame * np.hanning(480)
        r = np.correlate(w, w, "full")[479:]
        k = 32 + int(np.argmax(r[32:320]))
        share = r[k] / (r[0] + 1e-8)
        lag = k + (r[k - 1] - r[k + 1]) / (2 * (2 * r[k] - r[k - 1] - r[k + 1]) + 1e-8)
        f0.append(RATE / lag if share >= 0.45 else 0.0)
        if share >= 0.45:
            lags.append(lag / RATE)
            amps.append(np.abs(frame).max())
        hnr.append(30.0 if share >= 0.999 else 0.0 if share <= 0.01 else 10 * math.log10(share / (1 - share)))
        c = np.abs(np.fft.irfft(np.log(np.maximum(np.abs(np.fft.rfft(w, 1024)), 1e-6))))[20:200]
        cpp.append(20 * math.log10(c.max() / (c.mean() + 1e-8)) if c.max() > 1e-12 else 0.0)
        zcr.append(np.abs(np.diff(np.sign(w))).mean() / 2)
        energy.append((frame**2).sum())
        v = lifted * np.hamming(480)
        r = np.correlate(v, v, "full")[479:][:19]
        a, e = np.zeros(19), r[0]
        a[0] = 1
        for m in range(1, 19):
            g = -sum(a[i] * r[m - i] for i in range(m)) / (e + 1e-8)
            a = np.array([a[i] + g * a[m - i] if 0 < i <= m else a[i] for i in range(19)])
            e *= 1 - g * g
            if e <= 0:
                break
        roots = [z for z in np.roots(a) if z.imag > 0.01 and abs(z) < 0.999]
        found = sorted(f for f in (np.angle(z) * RATE / (2 * np.pi) for z in roots) if 200 <= f <= 5000)
        for held, f in zip(hz, found, strict=False):
            held.append(f)
    voiced = [f for f in f0 if f > 0]
    stats = [np.mean(voiced), np.std(voiced), min(voiced), max(voiced)] if len(voiced) > 1 else [0.0] * 4
    means = [np.mean(h) if h else 0.0 for h in hz]
    gap = (means[3] - means[0]) / 3 if means[3] and means[0] else (means[2] - means[0]) / 2 if means[2] and means[0] else 1000.0
    db = [abs(20 * math.log10(b / a)) for a, b in zip(amps, amps[1:], strict=False) if a > 0 and b > 0] if len(amps) >= 5 else []
    p = [e / (sum(energy[:50]) + 1e-8) for e in energy[:50] if e > 0]
    out = [*stats, len(voiced) / len(f0), *spread_of(lags), *spread_of(amps), np.mean(db) if db else 0.0, *means, gap, np.clip(17500 / gap, 10, 25) if gap > 0 else 17.5]
    return [*out, np.mean(hnr), np.std(hnr), np.mean(cpp), np.std(cpp), np.mean(zcr), -sum(q * math.log2(q + 1e-12) for q in p)], f0


def plain_spectral(x):
    x = np.append(x, np.zeros(max(0, 1024 - len(x))))
    z = np.array([np.fft.rfft(f * np.hanning(1024)) for f in slices(x, 1024, 256)])
    m, hz = np.abs(z), np.linspace(0, 8000, 513)
    rows = []
    for v in m:
        p = v / max(v.sum(), 1e-9)
        c = (p * hz).sum()
        s = math.sqrt((p * (hz - c) ** 2).sum() + 1e-12)
        cum = np.cumsum(v**2)
        rows.append((c, s, (p * (hz - c) ** 3).sum() / (s**3 + 1e-12), (p * (hz - c) ** 4).sum() / (s**4 + 1e-12), hz[np.flatnonzero(cum >= 0.85 * cum[-1])[0]], np.exp(np.log(v + 1e-10).mean()) / (v.mean() + 1e-10), v.max() / (np.sqrt((v**2).mean()) + 1e-10)))
    a = np.array(rows)
    flux = [np.sqrt((np.maximum(0, q - p) ** 2).mean()) for p, q in zip(m, m[1:], strict=False)] or [0.0]
    power = (m**2).mean(axis=0) + 1e-12
    db, cutoff = 10 * np.log10(power / power.max()), 0.0
    for i in range(int(1400 / 8000 * 513), 507):
        if db[i] < -42 and (db[i:] < -35).all() and db[i] - db[max(0, i - 12)] < -25 and db[i:].mean() < -45:
            cutoff = hz[i]
            break
    avg = a.mean(axis=0)
    return [avg[0], a[:, 0].std(), avg[1], avg[2], avg[3], np.mean(flux), np.std(flux), avg[4], avg[5], avg[6], power[hz >= 4000].sum() / power.sum(), float(cutoff > 0), cutoff], z


def plain_prosody(x, f0):
    sections = analysis.BANDPASS
    env = np.array([np.sqrt((f**2).mean()) for f in slices(kernels.filter_sections(sections, x), 480, 160)])
    out = [0.0] * 7
    if len(env) >= 5 and env.max() > 1e-6:
        db = 20 * np.log10(env / env.max() + 1e-6)
        k = plain_peaks(db, -30, 8, 1.5)
        gaps = np.diff(k) * 10.0
        d = np.abs(np.diff(gaps))
        pauses, run = [], 0
        for low in [*(db < -30), False]:
            if not low and run >= 20:
                pauses.append(run * 0.01)
            run = run + 1 if low else 0
        npvi = 100 * np.mean(d / ((gaps[1:] + gaps[:-1]) / 2)) if len(d) else 0.0
        out = [len(k) / (len(x) / RATE)] * 2 + [len(k), len(pauses), np.mean(pauses) if pauses else 0.0, npvi, np.mean(d) if len(d) else 0.0]
    v = np.array([f for f in f0 if f > 0])
    if len(v) < 5:
        return [*out, 0.0, 0.0, 0.0, 0.0]
    st, slope = 12 * np.log2(v / 100), np.diff(v) / 0.01
    wide = np.percentile(st, 95) - np.percentile(st, 5)
    signs = np.sign(slope)[np.abs(slope) > 10]
    return [*out, wide, slope.var(), float(v.std() < 8 or wide < 2), float((np.diff(signs) != 0).sum())]


def plain_artifacts(x):
    out = [0.0, 0.0, 0.0]
    if len(x) >= 1024 and (len(x) - 512) // 128 + 1 >= 8:
        m = np.array([np.abs(np.fft.rfft(f * np.hanning(512))) for f in slices(x, 512, 128)]).T
        up = m[int(257 * 0.4) :]
        if min(up.shape) >= 16:
            f = np.fft.fftshift(np.abs(np.fft.fft2(up - up.mean())))
            out[0] = sum(f[a, b].sum() for a in (slice(4), slice(-4, None)) for b in (slice(4), slice(-4, None))) / (f.sum() + 1e-9)
            out[1] = float(out[0] > 0.08)
        out[2] = analysis.smearing(m.mean(axis=1))
    if len(x) < 640:
        return [*out, 0.0, 0.0, 0.0]
    f = x[: len(x) // 160 * 160].reshape(-1, 160)
    jump = np.abs(np.diff(20 * np.log10(np.sqrt((f**2).mean(axis=1)) + 1e-8)))
    return [*out, float((jump > 18).sum()), jump.max(), np.abs(f[1:, 0] - f[:-1, -1]).max() * np.pi]


def plain_phase(x, z):
    out = [0.0] * 6
    if len(z) >= 3:
        away = np.abs(np.diff(np.unwrap(np.angle(z), axis=0), axis=0) / (2 * np.pi) - np.linspace(0, 0.5, 513))
        m = np.abs(z[:-1])
        out[:3] = away.mean(), away.var(), 1 / (1 + 2 * away[m > np.percentile(m, 80)].mean())
    if len(x) >= 1024 and len(z) >= 3:
        y = np.array([np.fft.rfft(f * np.hanning(1024) * np.arange(1024)) for f in slices(x, 1024, 256)])
        delay = ((z * y.conj()).real / (np.abs(z) + 1e-6) ** 1.8).mean(axis=0)
        phase = np.unwrap(np.angle(z), axis=1)
        h, _ = np.histogram(np.diff(phase, axis=1), 30, density=True)
        h = h[h > 1e-9]
        out[3:] = np.clip(delay.std() / (np.abs(delay).mean() + 1e-6) / 5, 0, 1), np.clip(-(h * np.log2(h)).sum() / 5, 0, 1), np.abs(np.diff(phase, n=2, axis=1)).mean()
    return out


def plain_peaks(y, height, distance, prominence):
    k = [i for i in range(1, len(y) - 1) if y[i - 1] < y[i] > y[i + 1] and y[i] >= height]
    keep = dict.fromkeys(k, True)
    for i in sorted(k, key=lambda i: (y[i], i), reverse=True):
        if keep[i]:
            for j in k:
                if j != i and abs(j - i) < distance:
                    keep[j] = False
    out = []
    for i in [i for i in k if keep[i]]:
        left = next((j for j in range(i, -1, -1) if y[j] > y[i]), -1)
        right = next((j for j in range(i, len(y)) if y[j] > y[i]), len(y))
        if y[i] - max(min(y[left + 1 : i + 1]), min(y[i:right])) >= prominence:
            out.append(i)
    return np.array(out, int)


def plain_features(x):
    if np.abs(x).max() < 0.015:
        return [0.0] * 60
    a, f0 = plain_acoustic(x) if len(x) >= 480 else ([0.0] * 24, [])
    s, z = plain_spectral(x)
    return [*a, *s, *plain_prosody(x, f0), *plain_artifacts(x), *plain_phase(x, z)]


def recordings():
    """Voices, tones, steps and noise of many lengths, as unsigned 8-bit samples."""
    rng = np.random.default_rng(7)
    out = {}
    for k, n in enumerate([1, 100, 479, 480, 700, 1023, 1024, 1500, 4000, 9000, 20480, 20481, 24000, 48000]):
        t = np.arange(n) / RATE
        f = 110 + 9 * k + 12 * np.sin(2 * np.pi * 1.7 * t)
        voice = sum(a * np.sin(2 * np.pi * h * np.cumsum(f) / RATE) for h, a in ((1, 0.5), (2, 0.3), (3, 0.2), (5, 0.15), (7, 0.1)))
        x = voice * (0.55 + 0.45 * np.sin(2 * np.pi * 4 * t)) + 0.01 * rng.standard_normal(n)
        x[(t % 0.9) > 0.65] *= 0.003
        out[k] = x * 0.6
    t = np.arange(30000) / RATE
    out[50] = np.where(t < 0.6, 0.05 * np.sin(2 * np.pi * 300 * t), 0.95 * np.sin(2 * np.pi * 800 * t))
    out[51] = 0.3 * rng.standard_normal(12000)
    out[52] = np.zeros(3000)
    out[53] = 0.5 * np.sin(2 * np.pi * 500 * t[:16000]) + 0.4 * np.sin(2 * np.pi * 1500 * t[:16000])
    return {k: np.clip(np.round(x * 128) + 128, 0, 255).astype(np.uint8).tobytes() for k, x in out.items()}


@pytest.fixture(scope="module")
def contents(spark):
    return spark.createDataFrame([*recordings().items(), (99, b""), (98, None)], "recording_id long, content binary").repartition(3)


@pytest.mark.parametrize("size", [analysis.SIZE, 1280])
def test_features_equal_plain_ones_of_whole_recordings(spark, contents, size, tmp_path):
    rows = analysis.frame_rows(blocks.pcm_blocks(contents, size, analysis.BEFORE, analysis.AFTER), size)
    rows.write.partitionBy("kind").parquet(f"file://{tmp_path}/rows")
    got = {r.recording_id: r for r in analysis.features(spark.read.parquet(f"file://{tmp_path}/rows"), parity=False).collect()}
    assert set(got) == set(recordings())
    for k, raw in recordings().items():
        x = (np.frombuffer(raw, np.uint8) - 128.0) / 128
        assert got[k].duration_sec == len(x) / RATE
        for name, expected in zip(FEATURES, plain_features(x), strict=True):
            # one unit of the last place; these two are counted in narrow bins
            near = 10.0 ** -DIGITS[name] + (2e-3 if name in ("phase_if_clustering", "phase_dispersion_entropy") else 1e-9 * abs(expected))
            assert abs(got[k][name] - expected) <= near, (k, name, got[k][name], expected)


def test_whole_recordings_have_the_plain_features(spark, contents):
    """Recordings of one block are measured many at a time, in groups, without a shuffle."""
    table = whole.whole_features(contents, parity=False)
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = {r.recording_id: r for r in table.collect()}
    assert set(got) == set(recordings())
    for k, raw in recordings().items():
        x = (np.frombuffer(raw, np.uint8) - 128.0) / 128
        assert got[k].duration_sec == len(x) / RATE
        for name, expected in zip(FEATURES, plain_features(x), strict=True):
            near = 10.0 ** -DIGITS[name] + (2e-3 if name in ("phase_if_clustering", "phase_dispersion_entropy") else 1e-9 * abs(expected))
            assert abs(got[k][name] - expected) <= near, (k, name, got[k][name], expected)


def test_groups_and_wanted_features_do_not_change_values(monkeypatch):
    """Each feature is the same alone as among all 60, and in whatever group its recording is."""
    own = [(np.frombuffer(raw, np.uint8) - 128.0) / 128 for raw in recordings().values()]
    peaks, rows = whole.measured(own, list(FEATURES))
    for k, name in enumerate(FEATURES):
        assert np.array_equal(whole.measured(own, [name])[1][:, 0], rows[:, k]), name
    monkeypatch.setattr(whole, "GROUP", 1)
    alone = whole.measured(own, list(FEATURES))
    assert np.array_equal(alone[0], peaks) and np.allclose(alone[1], rows, rtol=1e-9, atol=1e-9)
    assert whole.measured([], ["zcr_mean"])[1].shape == (0, 1)


def test_time_domain_features_need_no_spectra(monkeypatch):
    """What is not asked for is not worked out: neither spectra nor resonances nor envelopes."""
    def spectrum(*_, **__):
        raise AssertionError("not asked for")

    own = [(np.frombuffer(raw, np.uint8) - 128.0) / 128 for raw in recordings().values()]
    names = ["energy_entropy", "artifact_splice_points", "artifact_max_energy_jump_db", "artifact_max_phase_jump_rad"]
    expected = whole.measured(own, list(FEATURES))[1][:, [list(FEATURES).index(c) for c in names]]
    for at, name in ((np.fft, "rfft"), (np.fft, "irfft"), (analysis, "predictors"), (analysis, "resonances"), (analysis, "envelope_rhythm")):
        monkeypatch.setattr(at, name, spectrum)
    assert np.array_equal(whole.measured(own, names)[1], expected)


def test_verdicts_and_summaries_need_the_features_they_read(spark, contents, monkeypatch):
    """They ask for no others, and are the same as from all 60; verdicts need no cepstra and no moments."""
    from tessella.plans import recordings as plans

    full = plans.analysed(contents)
    asked, analysed = [], plans.analysed
    monkeypatch.setattr(plans.adapters, "recordings", lambda *_: contents)
    monkeypatch.setattr(plans, "analysed", lambda rows, **k: asked.append(k["names"]) or analysed(rows, **k))
    read = lambda df: {r.recording_id: r for r in df.collect()}
    assert read(plans.verify_samples(spark, "")) == read(plans.r6(plans.verdicts(full)))
    needed = {s for s, names in whole.SOURCES.items() if names & set(asked[0])}
    assert not needed & {"cepstra", "signs", "entropy", "moments"}
    told = read(plans.analysis_summaries(spark, ""))
    monkeypatch.setattr(plans, "analysed", lambda rows, **k: full)
    assert told == read(plans.analysis_summaries(spark, "")) and len(told) == len(recordings()) and "spectral_kurtosis_mean" not in asked[1]


def test_vectors_come_without_frames_of_short_recordings(spark, contents, monkeypatch):
    """The vector holds the 60 features in order; no recording of one block is cut for it."""
    from tessella.plans import recordings as plans

    monkeypatch.setattr(plans.adapters, "recordings", lambda *_: contents)
    monkeypatch.setattr(analysis, "frame_rows", lambda *_: pytest.fail("cut"))
    got = {r.recording_id: r.v for r in plans.analysis_vector(spark, "").collect()}
    assert got == {r.recording_id: [r[c] for c in FEATURES] for r in whole.whole_features(contents).collect()}


def test_recordings_of_one_block_have_no_rows_of_frames(spark, contents, monkeypatch):
    """Only recordings over one block are cut, written as frames and gathered again; together they are all recordings."""
    from tessella.plans import recordings as plans

    cut, frame_rows = [], analysis.frame_rows
    monkeypatch.setattr(analysis, "frame_rows", lambda b, size: cut.append(b) or frame_rows(b, size))
    one = {r.recording_id: r for r in plans.analysed(contents).collect()}
    assert not cut and set(one) == set(recordings())
    many = {r.recording_id: r for r in plans.analysed(contents, size=12800).collect()}
    assert {r.recording_id for r in cut[0].select("recording_id").distinct().collect()} == {k for k, raw in recordings().items() if len(raw) > 12800}
    assert all(one[k][c] == pytest.approx(many[k][c], rel=1e-9, abs=2 * 10.0 ** -DIGITS[c]) for k in one for c in FEATURES) and one.keys() == many.keys()


def test_simultaneous_roots_are_the_eigenvalues():
    """Roots of random polynomials, of one with a double root and of one with a root at zero; those that do not settle come from eigenvalues."""
    rng = np.random.default_rng(1)
    roots = rng.uniform(0.3, 0.99, (200, 9)) * np.exp(1j * rng.uniform(0, np.pi, (200, 9)))
    polynomials = np.array([np.real(np.poly([*r, *np.conj(r)])) for r in roots])
    found, settled = analysis.roots_of(polynomials)
    assert settled.mean() > 0.9 and max(np.abs(f[:, None] - np.append(r, np.conj(r))).min(axis=0).max() for f, r in zip(found[settled], roots[settled], strict=True)) < 1e-6
    own = [0.97 * np.exp(2j * np.pi * f / RATE) for f in (700, 700, 2600, 3500)]
    odd = np.array([np.real(np.poly([*own, *np.conj(own), *[0.1] * 10])), np.real(np.poly([*own[1:], *np.conj(own[1:]), *[0.0] * 12]))])
    got = analysis.resonances(np.concatenate([polynomials, odd]))
    assert np.allclose(got[:200], np.concatenate([analysis.resonances(p[None]) for p in polynomials]), atol=0.01, equal_nan=True)
    assert np.allclose(got[200], [700, 700, 2600, 3500], atol=1) and np.allclose(got[201, :3], [700, 2600, 3500], atol=1e-6)


def test_maps_and_vector_hold_the_features_in_order(spark):
    table = spark.createDataFrame([(1, 2.0, *map(float, range(60)))], ["recording_id", "duration_sec", *FEATURES])
    maps = analysis.feature_maps(table)
    assert maps.select(analysis.vector(maps).alias("v")).first().v == list(map(float, range(60)))
    assert [len(maps.first()[a]) for a in analysis.ANALYSERS] == list(analysis.ANALYSERS.values())


@pytest.mark.parametrize("size", [16, 100, 5000])
@pytest.mark.parametrize("kind", ["high4", "band", "high1"])
def test_filters_over_blocks_equal_the_sequential_filter(spark, size, kind):
    sections = {"high4": kernels.butterworth(4, 85.0, RATE, "high"), "band": analysis.BANDPASS, "high1": kernels.butterworth(1, 20.0, RATE, "high")}[kind]
    rng = np.random.default_rng(5)
    signals = {k: rng.standard_normal(n) for k, n in enumerate([1, 15, 16, 17, 99, 1000, 2301])}
    samples = spark.createDataFrame([(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)], "recording_id long, idx long, x double").repartition(5)
    got = recurrence.filtered(blocks.sample_blocks(samples, size, 3, 7), sections, size).collect()
    for k, x in signals.items():
        y = np.concatenate([r.samples for r in sorted((r for r in got if r.recording_id == k), key=lambda r: r.block)])
        assert np.allclose(y, kernels.filter_sections(sections, x), atol=1e-9)


def test_removing_dc_leaves_no_mean(spark):
    t = np.arange(16000) / RATE
    samples = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(0.2 * np.sin(2 * np.pi * 300 * t) + 0.3)], "recording_id long, idx long, x double")
    got = recurrence.remove_dc(samples, kernels.butterworth(1, 20.0, RATE, "high"), 3000)
    assert got.count() == 16000 and abs(got.agg({"x": "avg"}).first()[0]) < 0.05
    assert levels.remove_dc(samples).count() == 16000


def test_peaks_against_plain_search():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 3, 10, 400):
        y = rng.standard_normal(n).cumsum()
        for height, distance, prominence in ((-99, 1, 0), (0, 5, 0.5), (-1, 8, 1.5)):
            assert peaks.find_peaks(y, height, distance, prominence).tolist() == plain_peaks(y, height, distance, prominence).tolist()
    assert peaks.local_peaks(np.array([0, 1, 1, 1, 0, 2, 2, 3, 3])).tolist() == [2]


def test_resonances_of_a_known_filter():
    poles = [0.97 * np.exp(2j * np.pi * f / RATE) for f in (700, 1220, 2600, 3500)]
    polynomial = np.real(np.poly([*poles, *np.conj(poles)]))
    assert np.allclose(analysis.resonances(polynomial[None]), [[700, 1220, 2600, 3500]], atol=0.1)


def test_a_recording_of_one_block_is_summed_where_it_is(spark):
    rows = spark.createDataFrame([(1, bytes(np.random.default_rng(3).integers(90, 166, 5000, dtype=np.uint8)))], "recording_id long, content binary")
    made = analysis.frame_rows(blocks.pcm_blocks(rows, analysis.SIZE, analysis.BEFORE, analysis.AFTER))
    kinds = {r.kind for r in made.select("kind").distinct().collect()}
    assert "sums" in kinds and not kinds & {"power", "harmonics", "steps", "strong", "delay", "bend", "slopes"}
    cut = analysis.frame_rows(blocks.pcm_blocks(rows, 1280, analysis.BEFORE, analysis.AFTER), 1280)
    one, many = (analysis.summed(r).first().asDict() for r in (made, cut))
    assert all(one[c] == pytest.approx(many[c], rel=1e-9, abs=1e-9) for c in analysis.SUMMED)


def test_texts_of_usual_length_share_nothing_between_blocks(spark):
    """A recording of 130,000 samples is one block; one in many blocks hands on half of its spectrum's rows, as the others are their conjugates."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, bytes(np.random.default_rng(3).integers(0, 256, 130_000, dtype=np.uint8)))], "recording_id long, content binary")
    kinds = lambda size: {r.kind: (r.n, r.top) for r in analysis.frame_rows(blocks.pcm_blocks(rows, size, analysis.BEFORE, analysis.AFTER), size).groupBy("kind").agg(F.count("*").alias("n"), F.max("key").alias("top")).collect()}
    assert not {"grid", *analysis.ADDED} & set(kinds(analysis.SIZE))
    assert kinds(12800)["grid"] == (11 * 78, 77)


def test_top_names_rank_as_top_features(spark):
    from pyspark.sql import functions as F

    from tessella.operators import features

    z = spark.createDataFrame([(1, [0.5, -2.0, 2.0, 0.0, -0.0, 1.0, 5.0, -5.0])], "recording_id long, z array<double>")
    names = list("abcdefgh")
    long = z.select("recording_id", F.posexplode("z").alias("pos", "z")).withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1))
    ranked = [r.feature for r in features.top_features(long, 5).orderBy("rank").collect()]
    assert z.select(features.top_names(F.col("z"), names)).first()[0] == ranked == ["h", "g", "c", "b", "f"]


def test_embeddings_of_one_block_equal_those_of_many(spark):
    from tessella.operators import embedding

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, bytes(rng.integers(0, 256, n, dtype=np.uint8))) for k, n in enumerate((900, 1024, 3000, 4000))], "recording_id long, content binary")
    one, many = ({(r.recording_id, r.j): r.value for r in embedding.voice_embeddings(blocks.pcm_blocks(rows, size, 0, embedding.FFT), size).collect()} for size in (20480, 1280))
    assert len(one) == 4 * embedding.DIM and one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)
    pooled = embedding.pooled_blocks(blocks.pcm_blocks(rows, 20480, 0, embedding.FFT).where("n >= 1024"))
    assert pooled.count() == 3 and "Exchange" not in pooled._jdf.queryExecution().executedPlan().toString()
