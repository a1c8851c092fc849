"""Sources and sinks: round trips in scratch folders."""

import json
import math
import os
import zipfile

import pytest
from pyspark.sql import functions as F

import model
from helpers import ais, box, ports, rings, track
from vessel_flow import sinks
from vessel_flow.operators import ingest, manifest
from vessel_flow.operators.ports import build_ports
from vessel_flow.plans.pipeline import emission_pipeline
from vessel_flow.sources import ais_csv, dimensions

STD = "MMSI,BaseDateTime,LAT,LON,SOG,COG,VesselType,Status\n"


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_csv_headers_differing_in_order_are_read_by_name(spark, scratch):
    d = os.path.join(scratch, "2024")
    os.makedirs(d)
    _write(f"{d}/AIS_2024_01_01.csv", STD + "1,2024-01-01T00:00:00,30.0,-80.0,0.1,0,70,1\n"
                                            "2,2024-01-01T01:00:00,31.0,-81.0,12.5,0,89.5,1\n")
    # other column order, extra column, no Status
    _write(f"{d}/AIS_2024_01_02.csv", "BaseDateTime,VesselType,MMSI,Heading,SOG,LON,LAT\n"
                                      "2024-01-02T00:00:00,70.0,3,0,0.2,-82.0,32.0\n"
                                      "2024-01-02T00:10:00,abc,4,0,0.2,-82.0,32.0\n"
                                      "2024-01-02T00:20:00,,5,0,0.2,-82.0,32.0\n")
    _write(f"{d}/AIS_2024_01_03.csv", "MMSI,BaseDateTime,LAT,LON,SOG\n1,2024-01-03T00:00:00,1,2,3\n")  # no type
    _write(f"{d}/AIS_2024_01_04.csv", "")  # empty: Spark lists no split for it, so no rows
    _write(f"{d}/AIS_2024_01_05.csv", STD + "6,2024-01-05T00:00:00,30.0,-80.0,0.1,0,7")  # truncated line
    _write(f"{d}/notes.txt", "not a csv")
    scan = ais_csv.read_ais_csv(spark, scratch)
    rej = {os.path.basename(r["path"]): r["reason"] for r in scan.rejects.collect()}
    assert set(rej) == {"AIS_2024_01_03.csv"}
    assert "VesselType" in rej["AIS_2024_01_03.csv"]
    rows = {r["MMSI"]: r for r in scan.rows.collect()}
    assert rows["3"]["LAT"] == "32.0" and rows["3"]["LON"] == "-82.0" and rows["3"]["VesselType"] == "70.0"
    assert rows["3"]["Status"] is None and rows["1"]["Status"] == "1"
    typed = {r["MMSI"]: r for r in ingest.ingest(scan.rows).collect()}
    # "70.0" passes, 89.5 fails on the unrounded value, "abc" and "" drop out, 7 passes? no: 7 < 70
    assert set(typed) == {1, 3}
    assert typed[3]["VesselType"] == 70 and typed[1]["SOG"] == 0.1


def test_glob_picks_one_month(spark, scratch):
    for day in ("2024_01_31", "2024_02_01"):
        _write(f"{scratch}/AIS_{day}.csv", STD + f"1,{day.replace('_', '-')}T00:00:00,30,-80,0.1,0,70,1\n")
    scan = ais_csv.read_ais_csv(spark, scratch, glob="AIS_2024_02_*.csv")
    assert [r["BaseDateTime"][:10] for r in scan.rows.collect()] == ["2024-02-01"]


def test_zip_archives(spark, scratch):
    with zipfile.ZipFile(f"{scratch}/AIS_2024_01_01.zip", "w") as z:
        z.writestr("AIS_2024_01_01.csv", STD + "7,2024-01-01T00:00:00,30.0,-80.0,0.1,0,80,1\n")
    with zipfile.ZipFile(f"{scratch}/AIS_2024_01_02.zip", "w") as z:
        z.writestr("readme.txt", "nothing")
    _write(f"{scratch}/AIS_2024_01_03.zip", "broken")
    rows, status = ais_csv.read_zipped_ais(spark, scratch)
    got = rows.collect()
    assert [(r["MMSI"], r["VesselType"]) for r in got] == [("7", "80")]
    st = {r["day"].isoformat(): (r["has_csv"], r["error"]) for r in status.collect()}
    assert st["2024-01-01"] == (True, None)
    assert st["2024-01-02"] == (False, "No CSV found in zip")
    assert st["2024-01-03"][0] is False and st["2024-01-03"][1]
    cal = manifest.calendar(spark.createDataFrame([(2024,)], "year int"))
    present = manifest.listing_from_days(spark.createDataFrame([("2024-01-02",)], "day string")
                                         .select(F.to_date("day").alias("day")))
    tally = {r["status"]: r["files"] for r in manifest.tally(manifest.ingest_status(cal, present, status)).collect()}
    assert tally == {"SKIPPED": 1, "SUCCESS": 1, "FAILED": 364}


def test_listing_and_missing_days(spark, scratch):
    _write(f"{scratch}/AIS_2024_01_01.csv", STD)
    _write(f"{scratch}/AIS_2024_01_02.csv", "")  # empty: still to do
    present = manifest.listing(spark, scratch)
    cal = manifest.calendar(spark.createDataFrame([(2024,)], "year int"))
    todo = manifest.missing_days(cal, present)
    assert todo.count() == 365
    assert todo.filter(F.col("file_stem") == "AIS_2024_01_01").count() == 0


def test_geojson_polygon_hole_and_multipart(spark, scratch):
    outer = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "Holey"}, "geometry": {"type": "Polygon", "coordinates": [outer, hole]}},
        {"type": "Feature", "properties": {"name": "Two"}, "geometry": {"type": "MultiPolygon", "coordinates": [
            [[[10, 0], [11, 0], [11, 1], [10, 1]]], [[[12, 0], [13, 0], [13, 1], [12, 1], [12, 0]]]]}},
        {"type": "Feature", "properties": {"name": "Next"}, "geometry": {"type": "Polygon", "coordinates": [
            [[4, 0], [6, 0], [6, 4], [4, 4], [4, 0]]]}},
    ]}
    _write(f"{scratch}/states.geojson", json.dumps(fc))
    r = dimensions.read_states_geojson(spark, f"{scratch}/states.geojson")
    polys = {}
    for row in r.collect():
        polys.setdefault((row["ordinal"], row["name"]), []).extend(
            (e["x1"], e["y1"], e["x2"], e["y2"]) for e in row["edges"])
    assert sorted(polys) == [(0, "Holey"), (1, "Two"), (2, "Next")]
    assert len(polys[(1, "Two")]) == 8  # the open ring was closed
    pts = [(x / 2, y / 2) for x in range(-1, 28) for y in range(-1, 10)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "LON double, LAT double")
    from vessel_flow.operators.geo import state_cells, tag_states
    got = {(r["LON"], r["LAT"]): r["State"] for r in tag_states(df, state_cells(r)).collect()}
    for x, y in pts:
        exp = next((n for (o, n), e in sorted(polys.items()) if model.point_in_poly(e, x, y)), None)
        assert got[(x, y)] == exp, (x, y)
    assert got[(4.0, 2.0)] == "Holey"  # shared edge -> lowest ordinal
    assert got[(2.0, 2.0)] is None     # in the hole


def test_ports_csv_and_port_builder(spark, scratch):
    _write(f"{scratch}/ports.csv", "Main Port Name,state,Latitude,Longitude\nB,S1,1.0,2.0\nA,S2,3.0,4.0\n")
    p = dimensions.read_ports_csv(spark, f"{scratch}/ports.csv").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["name"]) for r in p] == [(0, "B"), (1, "A")]
    raw = spark.createDataFrame([("X", "1.5", "0.5", " us "), ("Y", "1.0", "1.0", "US"), ("Z", "0.5", "0.5", "CA"),
                                 ("W", "9", "9", "US")], "` port_name` string, `Latitude ` string, LONGITUDE string, country string")
    rg = rings(spark, [(0, "S0", box(0, 0, 1, 2)), (1, "S1", box(1, 0, 2, 2))])
    got = sorted((r["Main Port Name"], r["state"]) for r in build_ports(raw, rg).collect())
    assert got == [("X", "S0"), ("Y", "S0"), ("Y", "S1")]  # inner join keeps both border matches
    with pytest.raises(ValueError, match="Found"):
        build_ports(raw.drop("country"), rg)


def test_pipeline_sinks_round_trip(spark, scratch):
    rg = rings(spark, [(0, "A", box(0, 0, 1, 1)), (1, "B", box(1, 0, 2, 1)), (2, "C", box(2, 0, 3, 1))])
    ps = ports(spark, [(0, "PA", "A", 0.5, 0.5), (1, "PC", "C", 0.5, 2.5)])
    # three fast rows per leg: a lone fast row would be smoothed away (R-Q21)
    pts = [(0, 0.5, 0.5, 0.1), (90, 0.5, 0.5, 0.1), (150, 0.5, 1.5, 10.0), (180, 0.5, 1.5, 10.0),
           (210, 0.5, 1.6, 10.0), (270, 0.5, 2.5, 0.1), (400, 0.5, 2.5, 0.1), (430, 0.5, 1.5, 10.0),
           (460, 0.5, 1.5, 10.0), (490, 0.5, 1.5, 10.0), (520, 0.5, 0.5, 0.1), (700, 0.5, 0.5, 0.1)]
    df = ais(spark, track(42, pts))
    out = emission_pipeline(spark, df, ps, rg, stage_dir=f"{scratch}/stage")
    sinks.write_routes(out["route_table"], f"{scratch}/routes")
    sinks.write_transfers(out["transfers"], f"{scratch}/transfers")
    sinks.write_matrix_csv(out["transfers"], f"{scratch}/matrix")
    sinks.write_routes_wide_csv(out["route_table"], f"{scratch}/wide")
    r = sinks.stored(spark, f"{scratch}/routes", sinks.ROUTE_SCHEMA).collect()
    assert sorted((x["start_state"], x["end_state"]) for x in r) == [("A", "C"), ("C", "A")]
    assert all(json.loads(x["state_emissions"]).keys() == {"B"} for x in r)
    t = {(x["source_state"], x["dest_state"]): x["amount"] for x in sinks.stored(spark, f"{scratch}/transfers", sinks.TRANSFER_SCHEMA).collect()}
    assert set(t) == {("A", "B"), ("C", "B")}
    m = spark.read.option("header", True).csv(f"{scratch}/matrix").collect()
    assert sorted(m[0].asDict()) == ["B", "States with carbon transfer out", "Year"]
    w = spark.read.option("header", True).csv(f"{scratch}/wide")
    assert w.columns == ["Year", "MMSI", "Start Port", "Start State", "End Port", "End State", "Total Emissions", "B"]
    sinks.mark_done(spark, [2024], f"{scratch}/done")
    wanted = spark.createDataFrame([(2023,), (2024,)], "period int")
    assert [x["period"] for x in sinks.pending_periods(spark, wanted, f"{scratch}/done").collect()] == [2023]
    out["route_table"].unpersist()


def test_incremental_ingest_skips_files_done(spark, scratch):
    from vessel_flow.streaming import incremental_ingest
    src, dest = f"{scratch}/in", f"{scratch}/out"
    os.makedirs(src)
    _write(f"{src}/AIS_2024_01_01.csv", STD + "1,2024-01-01T00:00:00,30.0,-80.0,0.1,0,70,1\n")
    _write(f"{src}/AIS_2024_01_02.csv", "BaseDateTime,MMSI,LAT,LON,SOG,VesselType\n2024-01-02T00:00:00,2,31,-81,5,80\n")
    ck = f"{scratch}/ckpt"
    assert incremental_ingest(spark, src, dest, checkpoint=ck)["files"] == 2
    assert incremental_ingest(spark, src, dest, checkpoint=ck)["files"] == 0   # nothing new
    _write(f"{src}/AIS_2024_01_03.csv", STD + "3,2024-01-03T00:00:00,32.0,-82.0,0.1,0,60,1\n"
                                              "4,2024-01-03T01:00:00,32.0,-82.0,0.1,0,89,1\n")
    assert incremental_ingest(spark, src, dest, checkpoint=ck)["files"] == 1
    got = sorted((r["MMSI"], r["LAT"]) for r in spark.read.parquet(dest).collect())
    assert got == [(1, 30.0), (2, 31.0), (4, 32.0)]   # type 60 filtered out, columns read by name


def test_header_fallback_when_a_file_cannot_be_opened_directly(spark, scratch, monkeypatch):
    from vessel_flow.sources import ais_csv as mod
    d = f"{scratch}/y"
    os.makedirs(d)
    _write(f"{d}/AIS_2024_01_01.csv", "LAT,MMSI,BaseDateTime,LON,SOG,VesselType\n30.5,9,2024-01-01T00:00:00,-80,0.1,70\n")
    _write(f"{d}/AIS_2024_01_02.csv", "MMSI,LAT\n1,2\n")

    def unreadable(it):  # as if the file system were unknown to pyarrow
        import pandas as pd
        for pdf in it:
            yield pd.DataFrame({"path": pdf["path"], "header": None, "error": "ArrowInvalid: unknown scheme",
                                "source_file": pdf["source_file"]})
    monkeypatch.setattr(mod, "_read_first_lines", unreadable)
    scan = mod.read_ais_csv(spark, d)
    assert [(r["MMSI"], r["LAT"]) for r in scan.rows.collect()] == [("9", "30.5")]
    assert [os.path.basename(r["path"]) for r in scan.rejects.collect()] == ["AIS_2024_01_02.csv"]


def test_ingest_manifest(spark, scratch):
    csv_dir, zip_dir = f"{scratch}/csv", f"{scratch}/zip"
    os.makedirs(csv_dir)
    os.makedirs(zip_dir)
    _write(f"{csv_dir}/AIS_2023_12_31.csv", STD + "1,2023-12-31T00:00:00,30,-80,0.1,0,70,1\n")
    with zipfile.ZipFile(f"{zip_dir}/AIS_2023_01_01.zip", "w") as z:
        z.writestr("AIS_2023_01_01.csv", STD)
    m = manifest.ingest_manifest(spark, csv_dir, [2023], zip_dir)
    assert {r["status"]: r["files"] for r in m["tally"].collect()} == {"SKIPPED": 1, "SUCCESS": 1, "FAILED": 363}
    assert m["todo"].count() == 364
    failed = m["status"].filter("status = 'FAILED'").select("file_stem").limit(1).collect()[0][0]
    assert failed.startswith("AIS_2023_")


def test_emission_job_runs_pending_periods_only(spark, scratch):
    import datetime as dt
    from vessel_flow.plans.job import run_emission_job
    from vessel_flow.params import DEFAULT
    rg = rings(spark, [(0, "A", box(0, 0, 1, 1)), (1, "B", box(1, 0, 2, 1)), (2, "C", box(2, 0, 3, 1))])
    ps = ports(spark, [(0, "PA", "A", 0.5, 0.5), (1, "PC", "C", 0.5, 2.5)])
    pts = [(0, 0.5, 0.5, 0.1), (90, 0.5, 0.5, 0.1), (150, 0.5, 1.5, 10.0), (180, 0.5, 1.5, 10.0),
           (210, 0.5, 1.6, 10.0), (270, 0.5, 2.5, 0.1), (400, 0.5, 2.5, 0.1), (430, 0.5, 1.5, 10.0)]
    jan = track(1, pts, t0=dt.datetime(2024, 1, 10))
    feb = track(1, pts, t0=dt.datetime(2024, 2, 10))
    p = DEFAULT.with_(period="month")
    out = f"{scratch}/job"
    assert run_emission_job(spark, ais(spark, jan), ps, rg, out, p) == [202401]
    assert run_emission_job(spark, ais(spark, jan + feb), ps, rg, out, p) == [202402]   # January is done
    assert run_emission_job(spark, ais(spark, jan + feb), ps, rg, out, p) == []
    r = sinks.stored(spark, f"{out}/routes", sinks.ROUTE_SCHEMA)
    assert sorted((x["period"], x["start_state"], x["end_state"]) for x in r.collect()) == \
        [(202401, "A", "C"), (202402, "A", "C")]
    assert sorted(x["period"] for x in spark.read.parquet(f"{out}/done").collect()) == [202401, 202402]
    # the yearly transfer sums hold both months, not only the last run's
    flows = sinks.stored(spark, f"{out}/flows", sinks.FLOW_SCHEMA)
    t = {(x["source_state"], x["dest_state"]): x["amount"]
         for x in sinks.stored(spark, f"{out}/transfers", sinks.TRANSFER_SCHEMA).collect()}
    assert set(flows.select("period").distinct().toPandas()["period"]) == {202401, 202402}
    assert math.isclose(sum(t.values()), flows.agg(F.sum("amount")).first()[0], rel_tol=1e-12)


def test_daily_csv_files_give_the_same_routes_as_the_tables(spark, scratch):
    """Fixture positions written as one CSV per day, with the column order
    changing from day to day, read back through the header-checked scan."""
    from vessel_flow.operators import routes as R
    from vessel_flow.plans.queries import stages
    from vessel_flow.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    pdf = fx.ais_from_events(fx.table(spark, sf, "events")).toPandas()
    orders = [["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType"],
              ["VesselType", "SOG", "LON", "LAT", "BaseDateTime", "MMSI"],
              ["BaseDateTime", "MMSI", "SOG", "VesselType", "LAT", "LON"]]
    d = f"{scratch}/csv"
    os.makedirs(d)
    for i, (day, g) in enumerate(pdf.groupby(pdf["BaseDateTime"].dt.date)):
        g = g[orders[i % 3]].copy()
        g["BaseDateTime"] = g["BaseDateTime"].dt.strftime("%Y-%m-%dT%H:%M:%S.%f")
        g["LAT"], g["LON"], g["SOG"] = (g[c].map(repr) for c in ("LAT", "LON", "SOG"))
        g.to_csv(f"{d}/AIS_{day:%Y_%m_%d}.csv", index=False)
    scan = ais_csv.read_ais_csv(spark, d)
    assert scan.rejects.count() == 0
    nat = fx.table(spark, sf, "nation")
    from vessel_flow.plans.pipeline import build_stages
    via_csv = build_stages(scan.rows, fx.states_from_nation(nat), fx.ports_from_nation(nat)).table
    direct = stages(spark, sf).table

    def key(t):
        return sorted((r["MMSI"], r["start_time"], r["end_port"], round(r["total_emissions"], 6))
                      for r in R.routes(t).collect())
    a, b = key(via_csv), key(direct)
    assert a == b and len(a) == 48


def test_trajectory_and_port_tables_round_trip(spark, scratch):
    from vessel_flow.plans.queries import stages
    from vessel_flow.plans.pipeline import trajectory_output
    from vessel_flow.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    traj = trajectory_output(stages(spark, sf).trajectory)
    sinks.write_trajectory(traj, f"{scratch}/traj")
    back = dimensions.read_trajectory(spark, f"{scratch}/traj")
    assert back.count() == traj.count() and set(back.columns) == set(traj.columns)
    raw = fx.world_ports_from_supplier(fx.table(spark, sf, "supplier"))
    raw.write.option("header", True).csv(f"{scratch}/wpi")
    ports_df = build_ports(dimensions.read_world_ports(spark, f"{scratch}/wpi"),
                           fx.states_from_nation(fx.table(spark, sf, "nation")))
    sinks.write_ports_csv(ports_df, f"{scratch}/ports_csv")
    again = dimensions.read_ports_csv(spark, f"{scratch}/ports_csv")
    assert again.count() == ports_df.count() > 0
    assert set(again.columns) == {"ordinal", "name", "state", "lat", "lon"}


# --- faults, empty periods, re-entry -----------------------------------------

def test_zip_member_faults_are_told(spark, scratch):
    good = "AIS_2024_01_01.csv", STD + "7,2024-01-01T00:00:00,30.0,-80.0,0.1,0,80,5\n"
    with zipfile.ZipFile(f"{scratch}/AIS_2024_01_01.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(*good)
        z.writestr("b.csv", STD + "8,2024-01-01T00:00:00,30.0,-80.0,0.1,0,80,5\n" * 500)
    data = bytearray(open(f"{scratch}/AIS_2024_01_01.zip", "rb").read())
    at = data.index(b"b.csv") + 25
    data[at:at + 4] = b"\xff\xff\xff\xff"
    with open(f"{scratch}/AIS_2024_01_01.zip", "wb") as f:
        f.write(data)
    with zipfile.ZipFile(f"{scratch}/AIS_2024_01_02.zip", "w") as z:  # another order, and IMO
        z.writestr("a.csv", "IMO,VesselType,MMSI,BaseDateTime,SOG,LON,LAT\nIMO9,70,9,2024-01-02T00:00:00,1,-80,30\n")
    with zipfile.ZipFile(f"{scratch}/AIS_2024_01_03.zip", "w") as z:
        z.writestr("a.csv", "MMSI,LAT\n1,2\n")
    rows, status = ais_csv.read_zipped_ais(spark, scratch)
    st = {r["day"].day: r for r in status.collect()}
    assert not st[1]["has_csv"] and "b.csv" in st[1]["error"]
    assert st[2]["has_csv"] and st[2]["error"] is None and st[2]["lines"] == 1
    assert not st[3]["has_csv"] and "missing columns" in st[3]["error"]
    got = {r["MMSI"]: r for r in rows.collect()}
    assert got["9"]["IMO"] == "IMO9" and got["9"]["LAT"] == "30" and got["9"]["VesselType"] == "70"
    assert got["7"]["Status"] == "5"
    cal = manifest.calendar(spark.createDataFrame([(2024,)], "year int"))
    none = manifest.listing_from_days(spark.createDataFrame([], "day date"))
    tally = {r["status"]: r["files"] for r in manifest.tally(manifest.ingest_status(cal, none, status)).collect()}
    assert tally == {"SUCCESS": 1, "FAILED": 365}


def test_dropped_and_malformed_rows_are_counted(spark, scratch):
    _write(f"{scratch}/AIS_2024_01_01.csv", STD + "1,2024-01-01T00:00:00,30,-80,0.1,0,70,1\n"
           "x,2024-01-01T00:00:00,30,-80,0.1,0,70,1\n2,noon,30,-80,0.1,0,70,1\n3,2024-01-01T00:00:00,30\n"
           "367000000.0,2024-01-01T00:00:00,30,-80,0.1,0,70,1\n5.5,2024-01-01T00:00:00,30,-80,0.1,0,70,1\n")
    scan = ais_csv.read_ais_csv(spark, scratch)
    r = manifest.ingest_manifest(spark, scratch, [2024], report=True)["dropped"].first()
    assert (r["rows"], r["malformed"], r["no_vessel"], r["no_time"], r["dropped"]) == (6, 1, 2, 1, 3)
    assert sorted(x["MMSI"] for x in ingest.ingest(scan.rows).collect()) == [1, 367000000]


def test_a_long_header_is_read_to_its_end(spark, scratch):
    extra = ",".join(f"c{i}" for i in range(20000))
    _write(f"{scratch}/AIS_2024_01_01.csv", f"{extra},MMSI,BaseDateTime,LAT,LON,SOG,VesselType\n")
    assert len(ais_csv.file_headers(spark, scratch).first()["header"]) > 1 << 16


JOB_RINGS = [(0, "A", box(0, 0, 1, 1)), (1, "B", box(1, 0, 2, 1)), (2, "C", box(2, 0, 3, 1))]
JOB_PORTS = [(0, "PA", "A", 0.5, 0.5), (1, "PC", "C", 0.5, 2.5)]
JOB_TRACK = [(0, 0.5, 0.5, 0.1), (90, 0.5, 0.5, 0.1), (150, 0.5, 1.5, 10.0), (180, 0.5, 1.5, 10.0),
             (210, 0.5, 1.6, 10.0), (270, 0.5, 2.5, 0.1), (400, 0.5, 2.5, 0.1), (430, 0.5, 1.5, 10.0)]


def _job(spark, rows, out, **kw):
    from vessel_flow.params import DEFAULT
    from vessel_flow.plans.job import run_emission_job
    frame = rows if not isinstance(rows, list) else ais(spark, rows)
    return run_emission_job(spark, frame, ports(spark, JOB_PORTS), rings(spark, JOB_RINGS), out,
                            DEFAULT.with_(period="month"), **kw)


def test_job_without_flows_or_rows_writes_its_marker(spark, scratch):
    import datetime as dt
    t = lambda m: dt.datetime(2024, m, 10)
    still = track(1, JOB_TRACK[:2], t0=t(1))                      # a stay, no route
    out = f"{scratch}/job"
    assert _job(spark, still, out) == [202401]
    lost = track(2, [(0, None, None, 0.1), (90, None, None, 0.1)], t0=t(2))  # a rejected vessel, nothing kept
    assert _job(spark, still + lost, out) == [202402]
    other = [(*r[:5], 30) for r in track(3, JOB_TRACK, t0=t(3))]   # no freight at all
    assert _job(spark, still + lost + other, out) == [202403]
    assert _job(spark, still + lost + other, out) == []
    assert sinks.stored(spark, f"{out}/flows", sinks.FLOW_SCHEMA).count() == 0
    assert sinks.stored(spark, f"{out}/transfers", sinks.TRANSFER_SCHEMA).count() == 0
    rej = sinks.stored(spark, f"{out}/rejects", sinks.REJECT_SCHEMA).collect()
    assert [(r["period"], r["MMSI"]) for r in rej] == [(202402, 2)]
    traj = dimensions.read_trajectory(spark, f"{out}/trajectory")
    assert {r["MMSI"] for r in traj.collect()} == {1}
    assert set(traj.columns) == {"period", "year", "seq", "MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType",
                                 "Label", "TimeDiff", "CO2", "State", "PortName"}


def test_redo_with_a_smaller_result_leaves_nothing_stale(spark, scratch):
    import datetime as dt
    out = f"{scratch}/job"
    both = track(1, JOB_TRACK, t0=dt.datetime(2024, 1, 10)) + track(1, JOB_TRACK, t0=dt.datetime(2024, 2, 10))
    assert _job(spark, both, out) == [202401, 202402]
    before = sinks.stored(spark, f"{out}/transfers", sinks.TRANSFER_SCHEMA).agg(F.sum("amount")).first()[0]
    os.rename(f"{out}/done", f"{out}/done_before")
    sinks.mark_done(spark, [202401], f"{out}/done")
    rest = track(1, JOB_TRACK[:2], t0=dt.datetime(2024, 2, 10))
    assert _job(spark, both[:8] + rest, out) == [202402]
    flows = sinks.stored(spark, f"{out}/flows", sinks.FLOW_SCHEMA)
    assert {r["period"] for r in flows.collect()} == {202401}
    after = sinks.stored(spark, f"{out}/transfers", sinks.TRANSFER_SCHEMA).agg(F.sum("amount")).first()[0]
    assert math.isclose(after, before / 2, rel_tol=1e-12)


def test_job_prunes_a_partitioned_input(spark, scratch):
    import datetime as dt
    rows = track(1, JOB_TRACK, t0=dt.datetime(2023, 5, 10)) + track(1, JOB_TRACK, t0=dt.datetime(2024, 5, 10))
    month = F.year("BaseDateTime") * 100 + F.month("BaseDateTime")
    ais(spark, rows).withColumn("period", month).write.partitionBy("period").parquet(f"{scratch}/in")
    table = spark.read.parquet(f"{scratch}/in")
    cut = ingest.ingest(ingest.only_periods(table, [202405]))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "202405" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert plan.count("FileScan") == 1
    assert _job(spark, table, f"{scratch}/job", years=[2024]) == [202405]
    out = emission_pipeline(spark, ais(spark, rows), ports(spark, JOB_PORTS), rings(spark, JOB_RINGS), periods=[2024])
    assert {r["year"] for r in out["routes"].collect()} == {2024}
    out["route_table"].unpersist()


def test_staged_run_reads_its_own_periods(spark, scratch):
    import datetime as dt
    run = lambda y: emission_pipeline(
        spark, ais(spark, track(1, JOB_TRACK, t0=dt.datetime(y, 5, 10))), ports(spark, JOB_PORTS),
        rings(spark, JOB_RINGS), stage_dir=f"{scratch}/stage")
    run(2023)["route_table"].unpersist()
    out = run(2024)
    assert {r["period"] for r in out["routes"].collect()} == {2024}
    out["route_table"].unpersist()


def test_geojson_lines_get_dense_ordinals(spark, scratch):
    os.makedirs(f"{scratch}/g")
    for part in range(3):
        with open(f"{scratch}/g/part-{part}.json", "w") as f:
            for k in range(4):
                n = part * 4 + k
                ring = [[n, 0], [n + 1, 0], [n + 1, 1], [n, 1], [n, 0]]
                f.write(json.dumps({"type": "Feature", "properties": {"name": f"S{n}"},
                                    "geometry": {"type": "Polygon", "coordinates": [ring]}}) + "\n")
    got = dimensions.read_states_geojson(spark, f"{scratch}/g", one_feature_per_line=True).collect()
    assert sorted((r["ordinal"], r["name"]) for r in got) == [(n, f"S{n}") for n in range(12)]


def test_routes_from_a_saved_csv_trajectory(spark, scratch):
    from vessel_flow.operators import routes as R
    from vessel_flow.plans.pipeline import routes_from_trajectory
    from vessel_flow.plans.queries import stages
    s = stages(spark, "/root/testdata/sf0.001")
    saved = s.trajectory.select("MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType", "Label", "TimeDiff", "CO2",
                                "State", "PortName")
    (saved.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(f"{scratch}/t"))
    key = lambda t: sorted((r["MMSI"], r["start_time"], r["end_port"], round(r["total_emissions"], 6))
                           for r in R.routes(t).collect())
    again = dimensions.read_trajectory(spark, f"{scratch}/t", "csv")
    assert again.schema["LAT"].dataType.simpleString() == "double"
    assert key(routes_from_trajectory(again)) == key(s.table)


def test_burst_is_cut_by_rows(spark):
    from vessel_flow.operators import split
    from vessel_flow.plans.queries import PBURST
    from vessel_flow.sources import fixtures as fx
    events = fx.burst_events(fx.table(spark, "/root/testdata/sf0.001", "events"))
    rows = ingest.ingest(fx.ais_from_events(events, vessel="one"))
    hot = split.hot_vessels(split.vessel_stats(rows), PBURST)
    h = split.HotStages(split.mark_hot(rows, hot).where("hot").drop("hot"), hot, PBURST)
    sizes = [r["count"] for r in h.ingested.groupBy("chunk").count().collect()]
    assert len(sizes) == math.ceil(rows.count() / PBURST.chunk_rows) and max(sizes) <= PBURST.chunk_rows
    assert [r["seq"] for r in h.ingested.orderBy("BaseDateTime").collect()] == list(range(1, rows.count() + 1))


def test_mixed_headers_are_one_scan_without_a_list_of_files(spark, scratch, monkeypatch):
    """Two eras of like size: every line is read by its own file's header, and
    no file name reaches the driver."""
    for k in range(30):
        cols = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType"]
        values = [str(k), "2024-01-01T00:00:00", "30.0", "-80.0", "0.1", "70"]
        turn = slice(None, None, -1) if k % 2 else slice(None)
        _write(f"{scratch}/AIS_2024_01_{k + 1:02d}.csv", ",".join(cols[turn]) + "\r\n" + ",".join(values[turn]) + "\r\n\r\n")
    scan = ais_csv.read_ais_csv(spark, scratch)
    assert sorted((int(r["MMSI"]), r["LAT"], r["VesselType"]) for r in scan.rows.collect()) == [(k, "30.0", "70") for k in range(30)]
    plan = scan.rows._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("FileScan text") == 1 and "AIS_2024_01_01.csv" not in plan and "Union" not in plan
    small = ais_csv.read_ais_csv(spark, scratch, p=ais_csv.DEFAULT.with_(broadcast_max_bytes=1))
    assert small.rows.count() == 30


def test_every_line_is_a_row_or_in_quarantine(spark, scratch):
    _write(f"{scratch}/AIS_2024_01_01.csv", "\ufeff" + STD + '1,2024-01-01T00:00:00,30,-80,0.1,0,70,"1,5"\n' + STD +
           "1,2024-01-01T00:00:00,30,-80,0.1,0,70,1,9\n2,noon,30,-80,0.1,0,70,1\n,2024-01-01T00:00:00,30,-80,0.1,0,70,1\n3,2024\n")
    scan = ais_csv.read_ais_csv(spark, scratch)
    kept, bad = scan.rows.collect(), scan.quarantine.collect()
    assert [r["Status"] for r in kept] == ["1,5"] and scan.lines.count() == 5
    assert sorted((r["reason"], r["line"]) for r in bad) == [
        ("does not fit the header", "1,2024-01-01T00:00:00,30,-80,0.1,0,70,1,9"), ("does not fit the header", "3,2024"),
        ("no time", "2,noon,30,-80,0.1,0,70,1"), ("no vessel", ",2024-01-01T00:00:00,30,-80,0.1,0,70,1")]
    assert all(r["source_file"].endswith("AIS_2024_01_01.csv") for r in bad)


def test_an_archive_of_many_members_spreads_over_tasks(spark, scratch):
    with zipfile.ZipFile(f"{scratch}/AIS_2024_01_01.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(24):
            z.writestr(f"part_{k}.csv", STD + "".join(f"{k},2024-01-01T00:{m:02d}:00,30,-80,0.1,0,70,1\n" for m in range(50)))
    lines = ais_csv.zip_lines(spark, scratch, member_bytes=100)
    tasks = lines.where("line is not null").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(tasks) > 8 and sum(r["count"] for r in tasks) == 24 * 50
    rows, status = ais_csv.read_zipped_ais(spark, scratch)
    assert rows.count() == 1200 and [(r["csv_members"], r["lines"], r["has_csv"]) for r in status.collect()] == [(24, 1200, True)]


def test_members_are_read_by_ranges(scratch, monkeypatch):
    """Only the bytes of the named members are read, whatever else the archive holds."""
    import os
    import random
    path = f"{scratch}/AIS_2024_01_01.zip"
    noise = random.Random(1).randbytes(3_000_000)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("big.csv", noise)
        z.writestr("small.csv", STD + "1,2024-01-01T00:00:00,30,-80,0.1,0,70,1\n")
    import pandas as pd
    read = []
    plain = ais_csv._seekable

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n=-1):
            out = self.f.read(n) if n >= 0 else self.f.read()
            read.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    monkeypatch.setattr(ais_csv, "_seekable", lambda p: Counted(plain(p)))
    members = pd.concat(ais_csv._members([pd.DataFrame({"path": [path]})]))
    assert list(members["member"]) == ["big.csv", "small.csv"] and sum(read) < 100_000
    read.clear()
    out = pd.concat(ais_csv._inflate_members([members[members["member"] == "small.csv"]]))
    assert len(out) == 2 and sum(read) < 100_000 < os.path.getsize(path)


def test_ingest_stream_keeps_the_quarantine(spark, scratch):
    from vessel_flow.streaming import incremental_ingest
    os.makedirs(f"{scratch}/in")
    _write(f"{scratch}/in/AIS_2024_01_01.csv", STD + "1,2024-01-01T00:00:00,30,-80,0.1,0,70,1\n2,noon,30,-80,0.1,0,70,1\n")
    incremental_ingest(spark, f"{scratch}/in", f"{scratch}/out", checkpoint=f"{scratch}/ckpt")
    assert [r["reason"] for r in spark.read.parquet(f"{scratch}/out_quarantine").collect()] == ["no time"]


def test_reentry_from_buckets_has_no_vessel_exchange(spark, scratch):
    from vessel_flow.operators import routes as R
    from vessel_flow.plans.pipeline import routes_from_trajectory, trajectory_output
    from vessel_flow.plans.queries import stages
    from vessel_flow.sources import staged
    s = stages(spark, "/root/testdata/sf0.001")
    staged.write_staged(trajectory_output(s.trajectory), f"{scratch}/staged", 4)
    table = routes_from_trajectory(staged.read_staged(spark, f"{scratch}/staged"), placed=True)
    plan = R.routes(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan, plan
    key = lambda t: sorted((r["MMSI"], r["start_time"], r["end_port"], round(r["total_emissions"], 6))
                           for r in R.routes(t).collect())
    assert key(table) == key(s.table)


def test_saved_hot_vessel_is_cut_by_rows(spark):
    """Re-entry with and without ``seq``: the windows of a hot vessel are keyed by chunk."""
    from vessel_flow.operators import routes as R
    from vessel_flow.params import DEFAULT
    from vessel_flow.plans.pipeline import routes_from_trajectory, trajectory_output
    from vessel_flow.plans.queries import stages
    s = stages(spark, "/root/testdata/sf0.001")
    saved = trajectory_output(s.trajectory)
    p = DEFAULT.with_(hot_vessel_rows=20, chunk_rows=7)
    key = lambda t: sorted((r["MMSI"], r["start_time"], r["end_port"], round(r["total_emissions"], 6))
                           for r in R.routes(t).collect())
    want = key(s.table)
    for part in (saved, saved.drop("seq", "period", "year")):
        table = routes_from_trajectory(part, p)
        assert "chunk" in table._jdf.queryExecution().optimizedPlan().toString() or key(table) == want
        assert key(table) == want
