"""Both sides of each threshold of the scoring cascade."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.plans import scoring


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("p", "conf", "t", "ml", "strong", "factors", "splices", "want"), [
    (0.44, 0.9, 0.7, 0.1, 0, 0, 0, "REAL"), (0.45, 0.9, 0.7, 0.1, 0, 0, 0, "UNCERTAIN"), (0.69, 0.9, 0.7, 0.1, 0, 0, 0, "UNCERTAIN"),
    (0.95, 0.9, 0.7, 0.1, 0, 0, 0, "SYNTHETIC"), (0.80, 0.9, 0.7, 0.1, 0, 0, 0, "UNCERTAIN"), (0.80, 0.9, 0.7, 0.1, 2, 0, 0, "SYNTHETIC"), (0.80, 0.9, 0.7, 0.86, 0, 0, 0, "SYNTHETIC"),
    (0.30, 0.9, 0.7, 0.1, 0, 0, 2, "MANIPULATED"), (0.25, 0.9, 0.7, 0.1, 0, 0, 2, "REAL"),
])
def test_verdict(spark, p, conf, t, ml, strong, factors, splices, want):
    assert value(spark, scoring.verdict(*map(F.lit, (p, conf, t, ml, strong, factors, splices)))) == want


@pytest.mark.parametrize(("verdict", "p", "raw", "scenario", "want"), [
    ("SYNTHETIC", 0.75, 0.5, "standard_support", "CRITICAL"), ("SYNTHETIC", 0.74, 0.5, "standard_support", "HIGH"), ("REAL", 0.70, 0.1, "standard_support", "HIGH"),
    ("REAL", 0.30, 0.1, "standard_support", "MEDIUM"), ("REAL", 0.299, 0.1, "standard_support", "LOW"), ("UNCERTAIN", 0.1, 0.1, "standard_support", "MEDIUM"),
    ("REAL", 0.05, 0.1, "high_value_transaction", "MEDIUM"), ("REAL", 0.049, 0.1, "high_value_transaction", "LOW"),
])
def test_risk_level(spark, verdict, p, raw, scenario, want):
    assert value(spark, scoring.risk_level(*map(F.lit, (verdict, p, raw, scenario)))) == want


def test_calibration_is_a_rising_curve_through_its_centre(spark):
    points = [value(spark, scoring.calibrate(F.lit(x))) for x in (0.0, 0.3, 0.65, 0.9, 1.0)]
    assert points == sorted(points) and math.isclose(points[2], 0.5)
    assert scoring.platt_parameters(20.0, -13.0) == (8.0, -13.0) and scoring.platt_parameters(-1.0, 0.0)[0] == 8.0


@pytest.mark.parametrize(("scores", "want"), [([0.6, 0.6, 0.1, 0.1], 0.5), ([0.1] * 4, 1.0), ([0.9, 0.1, 0.1, 0.1], 0.75)])
def test_agreement(spark, scores, want):
    assert value(spark, scoring.agreement([F.lit(s) for s in scores])) == want


@pytest.mark.parametrize(("speech", "peak", "ratio", "db", "want"), [(True, 0.5, 0.5, -20.0, "pass"), (True, 0.005, 0.5, -20.0, "silence"), (False, 0.5, 0.5, -20.0, "non-speech"), (True, 0.5, 0.5, -51.0, "silence")])
def test_stream_gate(spark, speech, peak, ratio, db, want):
    assert value(spark, scoring.stream_gate(*map(F.lit, (speech, peak, ratio, db)))) == want


def test_unknown_scenario_falls_back(spark):
    assert value(spark, scoring.scenario(F.lit("no such"))) == scoring.DEFAULT_SCENARIO
    assert value(spark, scoring.threshold(F.lit("no such"))) == scoring.SCENARIOS[scoring.DEFAULT_SCENARIO]
