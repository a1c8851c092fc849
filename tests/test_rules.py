"""Hand cases, one per rule that decides results."""

import math

from pyspark.sql import functions as F

from helpers import ais, box, ports, rings, track
from vessel_flow.operators import routes as R
from vessel_flow.params import DEFAULT
from vessel_flow.plans.pipeline import build_stages

RINGS = [(0, "A", box(0, 0, 1, 1)), (1, "B", box(1, 0, 2, 1)), (2, "C", box(2, 0, 3, 1))]
PORTS = [(0, "PA", "A", 0.5, 0.5), (1, "PB", "B", 0.5, 1.5), (2, "PC", "C", 0.5, 2.5)]


def run(spark, rows, p=DEFAULT, polys=RINGS, ps=PORTS):
    return build_stages(ais(spark, rows), rings(spark, polys), ports(spark, ps), p)


def kept(spark, rows, **kw):
    s = run(spark, rows, **kw)
    return [r.asDict() for r in s.trajectory.orderBy("MMSI", "seq").collect()]


def test_smoothing_gate_and_nulls(spark):
    three = track(1, [(0, 0.5, 0.5, 5.0), (10, 0.6, 0.9, 7.0), (20, 0.5, 0.5, 9.0)])
    four = track(2, [(0, 0.5, 0.5, 5.0), (10, 0.6, 0.9, None), (20, 0.5, 0.5, 9.0), (30, None, 0.7, 1.0)])
    s = run(spark, three + four)
    got = {(r["MMSI"], r["seq"]): (r["LAT"], r["LON"], r["SOG"]) for r in s.smoothed.collect()}
    assert got[(1, 2)] == (0.6, 0.9, 7.0)                 # 3 rows: left alone
    assert got[(2, 1)] == ((0.5 + 0.6) / 2, (0.5 + 0.9) / 2, 5.0)  # first row: two values -> mean
    assert got[(2, 2)] == (0.5, 0.5, (5.0 + 9.0) / 2)      # null SOG in the middle: mean of the two others
    assert got[(2, 4)] == (0.5, (0.5 + 0.7) / 2, (9.0 + 1.0) / 2)  # null LAT at the end: the neighbour


def test_run_and_gap_boundaries(spark):
    # exactly 1 h slow run -> stop; 59 min -> not; one slow row -> not
    exact = track(1, [(0, .5, .5, 9), (10, .5, .5, 9), (20, .5, .5, .1), (50, .5, .5, .1), (80, .5, .5, .1),
                      (90, .5, .5, 9), (100, .5, .5, 9)])
    short = track(2, [(0, .5, .5, 9), (10, .5, .5, 9), (20, .5, .5, .1), (50, .5, .5, .1), (79, .5, .5, .1),
                      (90, .5, .5, 9), (100, .5, .5, 9)])
    s = run(spark, exact + short)
    runs = {r["MMSI"]: r["qualified"] for r in s.runs.filter("run_last").collect()}
    assert runs == {1: True, 2: False}
    labels = {m: "".join(r["Label"] for r in s.kept.filter(F.col("MMSI") == m).orderBy("seq").collect())
              for m in (1, 2)}
    assert labels == {1: "001100", 2: "0000000"}          # interior of the stop dropped


def _two_stops(mmsi, gap_min):
    a = [(0, .5, .5, 9), (10, .5, .5, 9), (20, .5, .5, .1), (50, .5, .5, .1), (80, .5, .5, .1)]
    mid = [(80 + gap_min / 3, .5, .6, 9), (80 + 2 * gap_min / 3, .5, .6, 9), (80 + gap_min - 0.5, .5, .6, 9)]
    t = 80 + gap_min
    b = [(t, .5, .5, .1), (t + 30, .5, .5, .1), (t + 60, .5, .5, .1), (t + 70, .5, .5, 9), (t + 80, .5, .5, 9)]
    return track(mmsi, a + mid + b)


def test_merge_gap_is_strict(spark):
    # gap measured from the first run's last row to the second run's first row
    s = run(spark, _two_stops(1, 60) + _two_stops(2, 59))
    stops = {m: s.stops.filter((F.col("MMSI") == m) & F.col("stop_start")).count() for m in (1, 2)}
    assert stops == {1: 2, 2: 1}                          # 60 min: two stops; 59 min: merged
    inside = s.kept.filter((F.col("MMSI") == 2) & (F.col("LON") == 0.6)).count()
    assert inside == 0                                    # fast rows inside a merged stop are dropped


def test_port_radius_is_an_arc_inclusive(spark):
    r = math.radians(0.2)
    m = 1.0 / (3440 * 1852) * 1.0                         # one metre, in radians
    lat_in = math.degrees(r - m)
    lat_out = math.degrees(r + m)

    def stop(mmsi, dlat):
        return track(mmsi, [(0, .5, .5, 9), (10, .5, .5, 9), (20, 0.5 + dlat, .5, .1), (50, 0.5 + dlat, .5, .1),
                            (80, 0.5 + dlat, .5, .1), (90, .5, .5, 9), (100, .5, .5, 9)])
    got = {r["MMSI"]: r["PortName"] for r in run(spark, stop(1, lat_in) + stop(2, lat_out)).trajectory
           .filter("Label = '1'").collect()}
    assert got == {1: "PA", 2: None}


def test_port_ties_and_antimeridian(spark):
    ps = [(0, "EAST", "E", 10.0, 179.95), (1, "TWIN2", "T", 40.0, 10.0), (2, "TWIN1", "T", 40.0, 10.0),
          (3, "NORTH", "N", 71.29, 20.0)]
    polys = [(0, "E", box(170, 0, 180, 20)), (1, "T", box(0, 30, 20, 50)), (2, "N", box(0, 60, 40, 80))]

    def stop(mmsi, la, lo):
        return track(mmsi, [(0, la, lo, .1), (60, la, lo, .1), (70, la, lo, 9), (80, la, lo, 9)])
    rows = stop(1, 10.0, -179.95) + stop(2, 40.0, 10.0) + stop(3, 71.29, 20.5) + stop(4, 71.29, 20.7)
    got = {r["MMSI"]: r["PortName"] for r in run(spark, rows, polys=polys, ps=ps).trajectory
           .filter("Label = '1'").collect()}
    # across +-180 (0.1 deg of longitude at 10 N), lowest ordinal among equals, 71.29 N:
    # 0.5 deg of longitude is ~0.16 deg of arc (inside), 0.7 deg ~0.22 (outside)
    assert got == {1: "EAST", 2: "TWIN2", 3: "NORTH", 4: None}


def test_stop_row_without_coordinates_rejects_the_vessel(spark):
    bad = track(1, [(0, .5, .5, 9), (10, None, .5, .1), (40, .5, .5, .1), (80, .5, .5, .1), (90, .5, .5, 9),
                    (95, .5, .5, 9)])
    good = track(2, [(0, .5, .5, 9), (10, .5, .5, 9)])
    s = run(spark, bad + good, p=DEFAULT.with_(smooth_min_rows=100))  # keep the null through smoothing
    assert [r["MMSI"] for r in s.rejects.collect()] == [1]
    assert {r["MMSI"] for r in s.trajectory.collect()} == {2}


def _routes(spark, pts, **kw):
    s = run(spark, track(7, pts), **kw)
    return [r.asDict() for r in R.routes_with_state_map(s.table).orderBy("start_time").collect()]


def stay(lon, t):
    """A stop of 90 min at a port: two kept rows, both at port."""
    return [(t, 0.5, lon, .1), (t + 45, 0.5, lon, .1), (t + 90, 0.5, lon, .1)]


def leg(lon, t):
    return [(t, 0.5, lon, 9.0), (t + 10, 0.5, lon, 9.0), (t + 20, 0.5, lon, 9.0)]


def test_one_stay_gives_no_route(spark):
    assert _routes(spark, leg(1.5, 0) + stay(0.5, 100) + leg(1.5, 300)) == []


def test_round_trip_and_back_to_back_ports(spark):
    # A -> (B transit) -> A is a route; two stops at A and B with nothing between are one stay
    pts = stay(0.5, 0) + leg(1.5, 200) + stay(0.5, 400)
    r = _routes(spark, pts)
    assert [(x["start_port"], x["end_port"]) for x in r] == [("PA", "PA")]
    assert dict(r[0]["state_emissions"]).keys() == {"B"}


def test_same_start_and_end_state_gets_both_halves(spark):
    pts = stay(0.5, 0) + leg(1.5, 200) + stay(0.5, 400)
    s = run(spark, track(7, pts))
    t = R.transit_emissions(s.table)
    f = R.transfer_flows(t).collect()
    assert [(x["source_state"], x["dest_state"]) for x in f] == [("A", "B"), ("A", "B")]
    assert math.isclose(sum(x["amount"] for x in f), t.collect()[0]["emissions"])


def test_zero_emission_transit_state_is_dropped(spark):
    # the B rows sit at the point where the next stop starts; that stop is matched to a C port
    # just across the border, so B's CO2 sum is 0: no transit state, but the route stays (R-Q6)
    ps = PORTS + [(3, "PC2", "C", 0.5, 2.05)]
    pts = stay(0.5, 0) + [(200, .5, 1.9, 9.0), (210, .5, 1.9, 9.0), (220, .5, 1.9, 9.0)] + stay(1.9, 400)
    s = run(spark, track(7, pts), ps=ps)
    assert sum(r["CO2"] for r in s.trajectory.filter("State = 'B'").collect()) == 0.0
    r = [x.asDict() for x in R.routes_with_state_map(s.table).collect()]
    assert [(x["start_port"], x["end_port"], x["state_emissions"]) for x in r] == [("PA", "PC2", None)]
    assert R.transit_emissions(s.table).count() == 0


def test_contiguous_ports_are_one_stay_named_after_the_first(spark):
    # one merged stop drifting from PA to PB: both end rows at port, so one stay "PA" (R-Q4)
    drift = [(-45, .5, .5, .1), (0, .5, .5, .1), (45, .5, 1.0, .1), (90, .5, 1.5, .1)]
    pts = drift + leg(1.5, 100) + leg(2.0, 200) + stay(2.5, 400)
    assert [(x["start_port"], x["end_port"]) for x in _routes(spark, pts)] == [("PA", "PC")]


def test_vessel_class_from_first_row(spark):
    rows = track(9, [(0, .5, .5, 9), (10, .5, .6, 9)], vtype=79) + track(9, [(20, .5, .7, 9)], vtype=80)
    s = run(spark, rows)
    assert {r["first_type"] for r in s.co2.collect()} == {79}
    assert not any(r["tanker"] for r in s.co2.collect())


def test_periods_cut_tracks_and_many_years_run_in_one_plan(spark):
    import datetime as dt
    # slow from 22:50 to 01:00 across a period boundary (R-Q14, U4)
    pts = [(0, .5, .5, 9), (10, .5, .5, 9), (20, .5, .5, .1), (60, .5, .5, .1), (90, .5, .5, .1),
           (120, .5, .5, .1), (150, .5, .5, .1), (160, .5, .5, 9), (170, .5, .5, 9)]

    def qualified(rows, p=DEFAULT):
        s = run(spark, rows, p=p)
        return sorted((r["period"], r["hours"]) for r in s.runs.filter("qualified").select(
            "period", (F.col("run_micros") / 3.6e9).alias("hours")).collect())

    new_year = track(5, pts, t0=dt.datetime(2023, 12, 31, 22, 30))
    # two years in one plan: 40 min before midnight (no stop), exactly 1 h after it (a stop)
    assert qualified(new_year) == [(2024, 1.0)]
    mid_year = track(6, pts, t0=dt.datetime(2024, 6, 30, 22, 30))
    assert qualified(mid_year) == [(2024, 130 / 60)]                          # a year keeps the voyage
    assert qualified(mid_year, DEFAULT.with_(period="month")) == [(202407, 1.0)]  # a month cuts it


def test_empty_period_gives_empty_tables_with_schema(spark, scratch):
    from vessel_flow import sinks
    from vessel_flow.plans.pipeline import emission_pipeline
    empty = ais(spark, [])
    out = emission_pipeline(spark, empty, ports(spark, PORTS), rings(spark, RINGS))
    for name in ("trajectory", "routes", "transit", "flows", "transfers", "rejects"):
        assert out[name].count() == 0, name
    assert {"MMSI", "start_state", "end_state", "total_emissions"} <= set(out["routes"].columns)
    assert out["trajectory"].columns[:3] == ["period", "year", "MMSI"]
    sinks.mark_done(spark, [2024], f"{scratch}/done")  # the empty period is still marked done (R-Q12)
    assert spark.read.parquet(f"{scratch}/done").count() == 1
    out["route_table"].unpersist()


def test_staged_pipeline_rejects_from_the_written_copy(spark, scratch):
    from vessel_flow.plans.pipeline import emission_pipeline
    bad = track(1, [(0, .5, .5, 9), (10, None, .5, .1), (40, .5, .5, .1), (80, .5, .5, .1), (90, .5, .5, 9),
                    (95, .5, .5, 9)])
    good = track(2, [(0, .5, .5, .1), (90, .5, .5, .1), (100, .5, 1.5, 9), (110, .5, 1.5, 9), (120, .5, 1.5, 9),
                     (200, .5, 2.5, .1), (300, .5, 2.5, .1)])
    p = DEFAULT.with_(smooth_min_rows=100)  # keep the null through smoothing
    df = ais(spark, bad + good)
    outs = []
    for stage in (None, f"{scratch}/stage"):
        o = emission_pipeline(spark, df, ports(spark, PORTS), rings(spark, RINGS), p, stage_dir=stage)
        outs.append(([tuple(r) for r in o["rejects"].orderBy("MMSI").collect()],
                     sorted(r["MMSI"] for r in o["trajectory"].collect()),
                     [(r["start_port"], r["end_port"]) for r in o["routes"].collect()]))
        o["route_table"].unpersist()
    assert outs[0] == outs[1]
    assert [r[1] for r in outs[0][0]] == [1] and set(outs[0][1]) == {2} and outs[0][2] == [("PA", "PC")]
