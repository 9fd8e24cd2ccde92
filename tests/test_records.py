"""Ingestion records, voicing and speech data: cases that the tables may not hold, and that queries see both classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import reports, speakers, voicing
from tessella.plans import registry


@pytest.mark.parametrize("name, column", [("vad_hangover", "is_speech"), ("chunk_speech_ratio", "contains_speech"), ("verify_recordings", "verdict"), ("timeline_bar", "bar"), ("frame_voicing", "kind")])
def test_queries_see_more_than_one_class(spark, sf, name, column):
    assert registry.QUERIES[name](spark, sf).select(column).distinct().count() > 1


def test_held_notes_count_distinct_pitches(spark):
    f0 = [200.0] * 5 + [300.0] * 4 + [0.0, 201.0, 202.0, 201.0, 400.0, 0.0]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(f0)] + [(2, 0, 0.0)], "recording_id long, idx long, f0 double")
    got = {r.recording_id: (r.n, r.held, r.notes) for r in voicing.held_notes(rows, least=3).collect()}
    assert got == {1: (15, 12, 2), 2: (1, 0, 0)}


def test_names_of_paths(spark):
    rows = spark.createDataFrame([("a/b.c/Voice.WAV",), ("x\\y\\z",), (".hidden",), ("",)], "p string")
    got = [tuple(r) for r in rows.select(reports.file_name(F.col("p")), reports.extension(F.col("p"))).collect()]
    assert got == [("Voice.WAV", ".wav"), ("z", ""), (".hidden", ".hidden"), ("", "")]


def test_enrolment_folds_all_samples(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=(12, 8))
    v = e[0] / np.linalg.norm(e[0])
    for n, x in enumerate(e[1:], 1):
        v = (v * n + x / np.linalg.norm(x)) / (n + 1)
        v /= np.linalg.norm(v)
    rows = spark.createDataFrame([("s", k, x.tolist()) for k, x in enumerate(e)], "speaker_id string, sample_no long, embedding array<double>")
    got = speakers.enroll(rows).first()
    assert got.sample_count == 12 and np.allclose(got.voiceprint, v)


@pytest.mark.parametrize("name", ["full_vector", "top_five_features", "vector_to_map"])
def test_maps_of_analysers_meet_in_shuffles(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "map_concat" not in plan


@pytest.mark.parametrize("name", ["kernel_features", "kernel_pitch_accuracy"])
def test_equal_voices_are_measured_once(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("MapInArrow")[1]
    assert "Aggregate [f0" in below and registry.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/customer.parquet").count()


def test_pitch_accuracy_measures_pitch_alone(spark, sf):
    """No formants, phases or resampling for a query that reads the pitch only; the pitch is that of kernel_features."""
    got = registry.QUERIES["kernel_pitch_accuracy"](spark, sf)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "formant_1" not in plan
    f0 = {r.recording_id: (r.f0, r.pitch) for r in registry.QUERIES["kernel_features"](spark, sf).select("recording_id", "f0", "pitch").collect()}
    assert {r.recording_id: r.pitch for r in got.collect()} == {i: int(own + 4 * round((pitch - own) / 4)) for i, (own, pitch) in f0.items()}


@pytest.mark.parametrize("name", ["top_five_features", "vector_to_map"])
def test_vectors_are_read_within_their_rows(spark, sf, name):
    """No row for each feature is ranked or collected: 60 times the recordings."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
