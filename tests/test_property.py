"""Window plans vs a sequential fold on many random vessels (one Spark job)."""

import datetime as dt
import json
import math
import random

import pytest

import model
from helpers import AIS_SCHEMA, box, ports, rings
from vessel_flow.params import DEFAULT
from vessel_flow.plans.pipeline import build_stages
from vessel_flow.operators import routes as R

# 3 x 3 grid of 1-degree boxes sharing edges; one port per box centre, two
# ports at one point (tie -> lowest ordinal), one port near a corner.
POLYS = [(k, f"S{k}", box(-80 + (k % 3), 30 + k // 3, -79 + (k % 3), 31 + k // 3)) for k in range(9)]
PORTS = [(k, f"P{k}", f"S{k}", 30.5 + k // 3, -79.5 + (k % 3)) for k in range(9)]
PORTS += [(9, "P9", "S0", 30.5, -79.5), (10, "P10", "S4", 31.05, -78.95)]


def random_tracks(seed, n_vessels):
    rnd = random.Random(seed)
    rows = []
    for v in range(n_vessels):
        mmsi = 1000 + v
        vtype = rnd.choice([70, 75, 79, 80, 85, 89])
        t = dt.datetime(2024, 5, 1) + dt.timedelta(minutes=rnd.randint(0, 600))
        n = rnd.choice([1, 2, 3, 4, 5, 8, 15, 30, 60])
        lat, lon = 30.5 + rnd.randint(0, 2), -79.5 + rnd.randint(0, 2)
        for _ in range(n):
            mode = rnd.random()
            if mode < 0.45:      # slow near a port
                sog = rnd.choice([0.0, 0.1, 0.2, 0.25])
                la, lo = lat + rnd.uniform(-0.1, 0.1), lon + rnd.uniform(-0.1, 0.1)
            elif mode < 0.9:     # moving
                sog = rnd.uniform(0.3, 20.0)
                lat = 30.5 + rnd.randint(0, 2)
                lon = -79.5 + rnd.randint(0, 2)
                la, lo = lat + rnd.uniform(-0.6, 0.6), lon + rnd.uniform(-0.6, 0.6)
            else:                # odd values: null SOG, on a border, at sea
                sog = rnd.choice([None, 0.3, 5.0])
                la, lo = rnd.choice([(31.0, -79.2), (30.5, -77.0), (lat, lon)])
            rows.append((mmsi, t, la, lo, sog, vtype))
            t += dt.timedelta(minutes=rnd.choice([5, 20, 30, 45, 59, 60, 61, 90, 180]))
    return rows


def _close(a, b, tol=1e-9):
    return math.isclose(a, b, rel_tol=tol, abs_tol=1e-9)


@pytest.mark.parametrize("seed,gap", [(1, 1.0), (2, 1.0), (3, 12.0)])
def test_pipeline_matches_sequential_model(spark, seed, gap):
    p = DEFAULT.with_(merge_gap_hours=gap)
    rows = random_tracks(seed, 300)
    df = spark.createDataFrame(rows, AIS_SCHEMA)
    s = build_stages(df, rings(spark, POLYS), ports(spark, PORTS), p)
    traj = {}
    for r in s.trajectory.select("MMSI", "seq", "BaseDateTime", "LAT", "LON", "SOG", "Label",
                                 "TimeDiff", "CO2", "State", "PortName").collect():
        traj.setdefault(r["MMSI"], []).append(r)
    got_routes = {}
    for r in R.routes_with_state_map(s.table).collect():
        got_routes.setdefault(r["MMSI"], []).append(r)

    by_v = {}
    for r in rows:
        by_v.setdefault(r[0], []).append(dict(zip(["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType"], r)))
    polys = [(o, n, e) for o, n, e in POLYS]
    n_routes = 0
    for mmsi, vrows in by_v.items():
        exp = model.vessel(vrows, polys, PORTS, p)
        got = sorted(traj.get(mmsi, []), key=lambda r: r["seq"])
        assert len(got) == len(exp), mmsi
        for g, e in zip(got, exp):
            assert g["BaseDateTime"] == e["BaseDateTime"]
            assert g["Label"] == e["Label"], (mmsi, g, e)
            assert _close(g["TimeDiff"], e["TimeDiff"])
            assert _close(g["CO2"], e["CO2"]), (mmsi, g, e)
            assert (g["State"], g["PortName"]) == (e["State"], e["PortName"]), (mmsi, g, e)
        exp_r = model.routes(exp)
        got_r = sorted(got_routes.get(mmsi, []), key=lambda r: r["start_time"])
        assert len(got_r) == len(exp_r), mmsi
        for g, e in zip(got_r, exp_r):
            assert (g["start_time"], g["start_port"], g["start_state"], g["end_port"], g["end_state"]) == e[:5]
            assert _close(g["total_emissions"], e[5])
            gm = dict(g["state_emissions"] or {})
            assert set(gm) == set(e[6]) and all(_close(gm[k], e[6][k]) for k in gm)
            # first-seen order; a collected MapType loses order, its JSON text keeps it
            order = list(json.loads(g["state_emissions_json"])) if g["state_emissions_json"] else []
            assert order == list(e[6])
        n_routes += len(exp_r)
    assert n_routes > 20  # the random tracks do exercise routes


def _snapshot(s):
    traj = sorted(tuple(r) for r in s.marked.select(
        "MMSI", "seq", "BaseDateTime", "LAT", "LON", "SOG", "Label", "TimeDiff", "CO2", "State", "PortName",
        "stay_start", "route_key").collect())
    tab = sorted((r["MMSI"], r["start_time"], r["end_time"], r["start_port"], r["end_port"], r["start_state"],
                  r["end_state"], round(r["total_emissions"], 9),
                  tuple((t["state"], round(t["emissions"], 9)) for t in r["transit"]))
                 for r in s.table.collect())
    runs = sorted(tuple(r) for r in s.runs.select("MMSI", "seq", "slow", "run_first", "run_last", "run_start_seq",
                                                  "qualified", "new_stop").collect())
    return traj, tab, runs


@pytest.mark.parametrize("hot_rows,chunk_rows,window", [(0, 3, 3), (20, 4, 3), (0, 1, 3), (0, 2, 5), (10, 7, 4)])
def test_hot_vessel_split_equals_plain_plan(spark, hot_rows, chunk_rows, window):
    rows = random_tracks(7, 120)
    df = spark.createDataFrame(rows, AIS_SCHEMA)
    plain = build_stages(df, rings(spark, POLYS), ports(spark, PORTS), DEFAULT.with_(split_hot=False, smooth_window=window))
    p = DEFAULT.with_(hot_vessel_rows=hot_rows, chunk_rows=chunk_rows, smooth_window=window)
    chunked = build_stages(df, rings(spark, POLYS), ports(spark, PORTS), p)
    assert chunked.persisted, "the split path did not run"
    a, b = _snapshot(plain), _snapshot(chunked)
    for x, y, what in zip(a, b, ("trajectory", "routes", "runs")):
        assert len(x) == len(y), what
        for u, v in zip(x, y):
            assert u == v, (what, u, v)
    chunked.release()


def test_pipeline_with_stage_dir_and_split_equals_plain(spark, scratch):
    from vessel_flow.plans.pipeline import emission_pipeline
    rows = random_tracks(11, 60)
    df = spark.createDataFrame(rows, AIS_SCHEMA)

    def outputs(p, stage):
        out = emission_pipeline(spark, df, ports(spark, PORTS), rings(spark, POLYS), p, stage_dir=stage)
        r = sorted((x["MMSI"], x["start_time"], x["end_port"], round(x["total_emissions"], 9))
                   for x in out["routes"].collect())
        t = sorted((x["source_state"], x["dest_state"], round(x["amount"], 9)) for x in out["transfers"].collect())
        out["route_table"].unpersist()
        return r, t

    plain = outputs(DEFAULT.with_(split_hot=False), None)
    split = outputs(DEFAULT.with_(hot_vessel_rows=5, chunk_rows=4), f"{scratch}/stage")
    assert plain == split and plain[0]


def test_merged_stops_match_the_fold(spark):
    from vessel_flow.operators.tracks import merged_stops
    rows = random_tracks(5, 200)
    s = build_stages(spark.createDataFrame(rows, AIS_SCHEMA), rings(spark, POLYS), ports(spark, PORTS),
                     DEFAULT.with_(split_hot=False))
    got = sorted((r["MMSI"], r["start_time"], r["end_time"]) for r in merged_stops(s.runs).collect())
    exp = []
    by_v = {}
    for r in rows:
        by_v.setdefault(r[0], []).append(dict(zip(["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType"], r)))
    for mmsi, vrows in by_v.items():
        k = model.collapse(model.smooth(sorted(vrows, key=lambda r: r["BaseDateTime"])))
        labelled = [r for r in k if r["Label"] == "1"]
        # with a 1 h minimum a stop has two end rows: (start, end) pairs in order
        for a, b in zip(labelled[0::2], labelled[1::2]):
            exp.append((mmsi, a["BaseDateTime"], b["BaseDateTime"]))
    assert got == sorted(exp) and got


@pytest.mark.parametrize("window", [4, 5])
def test_other_smoothing_windows_match_the_model(spark, window):
    p = DEFAULT.with_(smooth_window=window)
    rows = random_tracks(13, 80)
    s = build_stages(spark.createDataFrame(rows, AIS_SCHEMA), rings(spark, POLYS), ports(spark, PORTS), p)
    got = {(r["MMSI"], r["seq"]): (r["LAT"], r["LON"], r["SOG"]) for r in s.smoothed.collect()}
    by_v = {}
    for r in rows:
        by_v.setdefault(r[0], []).append(dict(zip(["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType"], r)))
    for mmsi, vrows in by_v.items():
        exp = model.smooth(sorted(vrows, key=lambda r: r["BaseDateTime"]), p)
        for i, e in enumerate(exp, start=1):
            g = got[(mmsi, i)]
            for a, b in zip(g, (e["LAT"], e["LON"], e["SOG"])):
                assert (a is None and b is None) or _close(a, b), (mmsi, i, g, e)
