"""Streams: hopping windows equal their batch statement whatever the packets' cuts, and state goes on across batches."""

import numpy as np
import pytest

from tessella.streaming import windows


def run(spark, packets, folder, size, hop):
    """Packets in files of one row each, read one file a batch."""
    schema = "session_id string, seq long, sample_rate int, samples array<double>"
    for k, row in enumerate(packets):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        assert k < 50
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = windows.hopping_windows(stream, size, hop)
    done = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").orderBy("session_id", "start_idx").collect()


@pytest.mark.parametrize("cuts", [[7, 5, 12], [24]])
def test_windows_do_not_depend_on_packets(spark, tmp_path, cuts):
    x = np.random.default_rng(0).normal(size=24)
    packets, at = [], 0
    for seq, n in enumerate(cuts):
        packets.append(("s", seq, 16000, x[at : at + n].tolist()))
        at += n
    got = run(spark, packets, f"file://{tmp_path}", 10, 4)
    assert [(r.window_no, r.start_idx, r.n) for r in got] == [(k, 4 * k, 10) for k in range(4)]
    for r in got:
        w = x[r.start_idx : r.start_idx + 10]
        assert (r.mean, r.peak, r.rms) == pytest.approx((w.mean(), np.abs(w).max(), np.sqrt((w * w).mean())))


def test_rate_change_and_bad_samples(spark, tmp_path):
    packets = [("s", 0, 16000, [1.0] * 6), ("s", 1, 8000, [float("nan")] + [2.0] * 9)]
    got = run(spark, packets, f"file://{tmp_path}", 10, 10)
    assert [(r.n, round(r.mean, 6), r.peak) for r in got] == [(10, 1.8, 2.0)]


def test_gate(spark):
    rows = spark.createDataFrame([(0.5, 0.1), (0.001, 0.1), (0.5, 1e-9)], "peak double, rms double")
    assert [r.scored for r in windows.gated(rows).collect()] == [True, False, False]


def test_a_session_that_ends_leaves_no_state(spark, tmp_path):
    rows = [("a", 0, 16000, [0.5] * 40, False), ("a", 1, 16000, [0.25] * 40, True), ("b", 0, 16000, [0.5] * 40, False)]
    schema = "session_id string, seq long, sample_rate int, samples array<double>, `end` boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    cut = windows.hopping_windows(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 32, 16)
    run = cut.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(p.stateOperators[0].numRowsUpdated for p in run.recentProgress) == 1 and run.lastProgress.stateOperators[0].numRowsTotal == 1
    got = sorted((r.session_id, r.window_no) for r in spark.read.schema(cut.schema).parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]


def test_windows_are_measured_where_they_are_cut(spark, tmp_path):
    """Packets of bytes give the windows of decoded ones; those that pass the gate leave with their features instead of samples, and their verdicts are those from samples."""
    from pyspark.sql import functions as F

    from tessella.operators import whole
    from tessella.plans import recordings
    from tessella.streaming import packets

    t = np.arange(40000) / 16000
    voice = 0.3 * sum(a * np.sin(2 * np.pi * h * (130 * t + 2 * np.sin(9 * t))) for h, a in ((1, 0.5), (2, 0.3), (3, 0.2))) + 0.01 * np.random.default_rng(0).standard_normal(40000)
    raw = np.clip(np.round(np.concatenate([voice, np.zeros(20000)]) * 128) + 128, 0, 255).astype(np.uint8).tobytes()
    rows = [("a", k, 16000, raw[4000 * k : 4000 * k + 4000], "uint8") for k in range(15)]
    sent = spark.createDataFrame(rows, "session_id string, seq long, sample_rate int, payload binary, encoding string")
    sent.coalesce(1).write.parquet(f"{tmp_path}/in")
    packets.decode_packets(sent).coalesce(1).write.parquet(f"{tmp_path}/decoded")

    def cut(folder, **kind):
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{folder}").schema).parquet(f"{tmp_path}/{folder}")
        got = windows.hopping_windows(stream, 16000, 8000, voice=True, **kind)
        got.writeStream.format("parquet").option("path", f"{tmp_path}/{folder}-out").option("checkpointLocation", f"{tmp_path}/{folder}-progress").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(got.schema).parquet(f"{tmp_path}/{folder}-out")

    near, far = cut("in", measure=recordings.SCORED), cut("decoded", keep=True)
    assert "samples" not in near.columns
    same = [c.split()[0] for c in windows.WINDOWS.split(", ") if "received" not in c]
    read = lambda df, *names: sorted(tuple(r) for r in df.select("session_id", "window_no", *names).collect())
    assert read(near, *same[2:]) == read(far, *same[2:]) and near.count() == 6
    judged = "gate", "probability", "verdict", "risk_level", "action", "acoustic", "phase", "factors"
    assert read(recordings.live_verdicts(near), *judged) == read(recordings.live_verdicts(far), *judged)
    gates = {r.window_no: r.gate for r in recordings.live_verdicts(near).collect()}
    assert {r.window_no for r in near.where(F.col("v").isNotNull()).collect()} == {k for k, g in gates.items() if g == "pass"} and set(gates.values()) == {"pass", "silence"}
    assert near.where("v IS NOT NULL").select(F.size("v")).first()[0] == len(recordings.SCORED) < len(whole.NAMES)
