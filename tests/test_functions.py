"""Scalar functions F1-F7 against plain Python."""

import math

from pyspark.sql import functions as F

import model
from vessel_flow.functions import haversine_nm, is_slow, mean_speed, move_emission, stop_emission
from vessel_flow.params import DEFAULT as P


def test_haversine_matches_python_and_null_rules(spark):
    pts = [(30.0, -80.0, 30.5, -79.5), (0.0, 179.9, 0.0, -179.9), (71.29, 20.0, 71.29, 20.5),
           (10.0, 10.0, 10.0, 10.0), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(pts, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_nm("a", "b", "c", "d")).collect()]
    for g, (a, b, c, d) in zip(got, pts):
        e = model.haversine(a, b, c, d)
        assert (g is None and e is None) or math.isclose(g, e, rel_tol=1e-12, abs_tol=1e-12)


def test_mean_speed_floor_and_slow_flag(spark):
    rows = [(0.0, 0.0), (0.1, None), (None, 3.0), (-1.0, 1.0), (4.0, 6.0), (0.29, 0.31)]
    df = spark.createDataFrame(rows, "s double, n double")
    got = [tuple(r) for r in df.select(mean_speed(F.col("s"), F.col("n"), P), is_slow(F.col("s"), P)).collect()]
    assert got == [(0.1, True), (0.1, True), (0.1, False), (0.1, True), (5.0, False), (0.3, True)]


def test_emission_formulas(spark):
    df = spark.createDataFrame([(2.0, 30.0, 10.0, False), (2.0, 30.0, 10.0, True)],
                               "td double, dist double, speed double, tanker boolean")
    got = df.select(stop_emission(F.col("td"), F.col("tanker"), P).alias("s"),
                    move_emission(F.col("dist"), F.col("speed"), F.col("tanker"), P).alias("m")).collect()
    # fixed reference rates: power * 213.1 g/kWh * 1e-6, times 3.114 t CO2 per t fuel
    assert math.isclose(got[0]["s"], 2.0 * (1776 * 213.1 * 1e-6) * 3.114, rel_tol=1e-15)
    assert math.isclose(got[1]["s"], 2.0 * (1985 * 213.1 * 1e-6) * 3.114, rel_tol=1e-15)
    assert math.isclose(got[0]["m"], (9300 * 213.1 * 1e-6) * (30.0 / 10.0) * 3.114, rel_tol=1e-15)
    assert math.isclose(got[1]["m"], (9400 * 213.1 * 1e-6) * (30.0 / 10.0) * 3.114, rel_tol=1e-15)
