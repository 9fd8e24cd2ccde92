"""Voice activity of windows, streams that use it, and sinks that repeat batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import activity
from tessella.functions.resample import polyphase
from tessella.streaming import sinks, windows

RATE = 16000


def speech(rate=RATE, seconds=4.0, seed=0):
    """The fixture voice: speech from 0 to 1.2 and 1.8 to 3.2 seconds, low noise elsewhere."""
    t = np.arange(int(rate * seconds)) / rate
    f = 130 + 10 * np.sin(2 * np.pi * 1.5 * t)
    x = sum(a * np.sin(2 * np.pi * h * np.cumsum(f) / rate) for h, a in ((1, 0.5), (2, 0.3), (3, 0.2), (5, 0.15), (7, 0.1)))
    on = (t < 1.2) | ((t >= 1.8) & (t < 3.2))
    x = x * on + 0.005 * np.random.default_rng(seed).standard_normal(len(t))
    return 0.8 * x / np.abs(x).max()


def test_speech_and_silence():
    got = activity.segments(speech(), RATE)
    spoken = sum(b - a for a, b, on in got if on) / RATE
    assert len(got) >= 2 and 1.0 < spoken and sum(b - a for a, b, on in got if not on) / RATE > 0.5
    assert 0.3 < activity.speech_share(speech(), RATE) < 0.85
    assert activity.segments(np.zeros(32000), RATE) == [(0, 32000, False)] and activity.speech_share(np.zeros(0), RATE) == 0
    assert activity.segments(np.full(100, 0.5), RATE) == [(0, 100, True)]
    assert got[0][0] == 0 and got[-1][1] == 64000


def test_music_is_no_speech():
    t = np.arange(4 * RATE) / RATE
    kick = 0.9 * np.sin(2 * np.pi * 50 * t)
    melody = sum(0.4 * np.sin(2 * np.pi * f * t) * ((t // 1) == k) for k, f in enumerate((110.0, 147.0, 196.0, 262.0)))
    assert activity.speech_share(kick, RATE) == 0 and activity.speech_share(melody, RATE) == 0


def test_smoothing():
    f = lambda s: np.array([c == "1" for c in s])
    s = lambda a: "".join("1" if v else "0" for v in a)
    assert s(activity.smooth(f("001110011100"), 2, 3)) == "001111111100"
    assert s(activity.smooth(f("110001111111"), 2, 3)) == "000001111111"
    assert s(activity.smooth(f("0110"), 9, 3)) == "0000" and s(activity.smooth(f(""), 2, 2)) == ""


def test_held_notes():
    assert activity.held_notes(np.array([100.0] * 30 + [150.0] * 30 + [100.0] * 30 + [0.0] * 10)) == (2, 90)
    assert activity.held_notes(np.array([100.0] * 23)) == (0, 0)


def stream(spark, folder, batches, *args, **kwargs):
    """The windows of packets that arrive a list of them a batch."""
    schema = "session_id string, seq long, sample_rate int, samples array<double>, reset boolean, received_ms double"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    packets = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = windows.hopping_windows(packets, *args, **kwargs)
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def packet(seq, samples, rate=RATE, reset=False, at=None):
    return ("s", seq, rate, None if samples is None else [float(v) for v in samples], reset, at)


@pytest.mark.parametrize("cuts", [[4], [2, 2], [1, 1, 1, 1]])
def test_repeated_packets_count_once_however_they_fall_into_batches(spark, tmp_path, cuts):
    rows = [packet(0, [1] * 8), packet(1, [2] * 8), packet(1, [2] * 8), packet(2, [3] * 8)]
    batches, at = [], 0
    for n in cuts:
        batches.append(rows[at : at + n])
        at += n
    got = stream(spark, f"file://{tmp_path}", batches, 8, 8).orderBy("window_no").collect()
    assert [(r.window_no, r.mean) for r in got] == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_windows_are_resampled_and_searched_for_voice(spark, tmp_path):
    x = speech(48000)
    batches = [[packet(k, x[a : a + 24000], 48000, at=1000.0 * k)] for k, a in enumerate(range(0, len(x), 24000))]
    got = stream(spark, f"file://{tmp_path}", batches, 48000, 48000, target_rate=RATE, voice=True).orderBy("window_no").collect()
    assert [r.n for r in got] == [16000] * 4 and [r.received_ms for r in got] == [1000.0, 3000.0, 5000.0, 7000.0]
    for k, r in enumerate(got):
        w = polyphase(x[48000 * k : 48000 * (k + 1)], 48000, RATE)
        assert (r.rms, r.speech_ratio) == pytest.approx((np.sqrt((w * w).mean()), activity.speech_share(w, RATE)))
    assert got[0].speech_ratio > 0.9 and got[2].speech_ratio > 0.9 and got[3].speech_ratio < 0.6


def test_rates_may_change_and_late_packets_are_left_out(spark, tmp_path):
    """A control packet without samples changes the rate: held samples go, counting goes on; a late packet is dropped; a reset starts anew."""
    batches = [[packet(0, [1] * 6)], [packet(1, None, 8000)], [packet(2, [2] * 10, 8000)], [packet(1, [9] * 10, 8000)], [packet(3, [4] * 10, 8000)], [packet(0, [5] * 10, 8000, True)], [packet(1, [6] * 10, 8000)]]
    got = stream(spark, f"file://{tmp_path}", batches, 10, 10, target_rate=8000).collect()
    assert sorted((r.window_no, round(r.mean, 6)) for r in got) == [(0, 2.0), (0, 5.0), (1, 4.0), (1, 6.0)]


def test_idle_sessions_are_dropped(spark):
    """The state function forgets a session that has timed out."""
    held = {}

    class State:
        def __init__(self, timed_out):
            self.hasTimedOut, self.timeout = timed_out, None

        exists = property(lambda self: "v" in held)
        get = property(lambda self: held["v"])
        update = lambda self, v: held.update(v=v)
        remove = lambda self: held.clear()
        setTimeoutDuration = lambda self, ms: held.update(ms=ms)

    taken = []

    class Packets:
        def groupBy(self, key):
            return self

        def applyInPandasWithState(self, step, *rest):
            taken.append((step, rest[-1]))

    windows.hopping_windows(Packets(), 10, 10, idle_minutes=5)
    step, timeout = taken[0]
    assert timeout == "ProcessingTimeTimeout"
    rows = pd.DataFrame([{"session_id": "s", "seq": 0, "sample_rate": RATE, "samples": [1.0] * 4}])
    assert list(step(("s",), iter([rows]), State(False))) == [] and len(held["v"][0]) == 4 and held["ms"] == 300_000
    assert list(step(("s",), iter([]), State(True))) == [] and not held


def test_latency_counts_from_the_packet_that_completed_a_window(spark):
    now = spark.range(1).select(F.unix_micros(F.current_timestamp()) / 1000).first()[0]
    rows = spark.createDataFrame([(1, now - 1500.0), (2, now + 60_000.0), (3, None), (4, float("nan"))], "k int, received_ms double")
    got = {r.k: r.latency_ms for r in windows.with_latency(rows).collect()}
    assert 1500 <= got[1] < 60_000 and got[2] == 0 and got[3] is None and got[4] is None


SCORED = "session_id string, risk_level string, verdict string, probability double, action string, factors array<string>"


def test_a_batch_that_runs_again_alerts_once(spark, tmp_path, capsys):
    base = f"file://{tmp_path}"
    levels = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    for k in range(3):
        rows = [(f"s{k}{j}", level, "SYNTHETIC", 0.876, "ACT", ["a", "b", "c", "d"]) for j, level in enumerate(levels)]
        spark.createDataFrame(rows, SCORED).coalesce(1).write.parquet(f"{base}/in/{k}")
    source = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    sinks.alert_sink(source, f"{base}/alerts", f"{base}/progress", show=True).awaitTermination()
    sinks.verdict_sink(source, f"{base}/verdicts", f"{base}/progress2").awaitTermination()
    assert capsys.readouterr().out.count("SYNTHETIC") == 6
    for p in sorted((tmp_path / "progress" / "commits").glob("*2*")):
        p.unlink()  # as if the query had died after writing its last batch
    sinks.alert_sink(source, f"{base}/alerts", f"{base}/progress").awaitTermination()
    got = sinks.read_sink(spark, f"{base}/alerts", f"{SCORED}, line string").collect()
    assert sorted(r.session_id for r in got) == sorted(f"s{k}{j}" for k in range(3) for j in (1, 2, 3)) and {r.batch for r in got} == {0, 1, 2}
    assert all((r.line is None) == (r.risk_level == "MEDIUM") for r in got)
    assert sinks.read_sink(spark, f"{base}/verdicts", SCORED, "json").count() == 12
