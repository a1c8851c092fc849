"""Registered queries over the shared test tables, each with DuckDB SQL.

Every query reads ``events`` (as AIS positions) and ``nation`` (as ports
and state boxes), or ``supplier`` (as a world port list), over the whole
tables.  Column names match between the Spark result and the SQL; doubles
are rounded to 6 places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import sinks
from ..operators import emissions, ingest, manifest, matrix, metrics, ports, routes, tracks
from ..params import DEFAULT, Params
from ..session import checkpoint_dir
from ..sources import ais_csv, dimensions, fixtures as fx, staged
from . import oracle as O
from .job import run_emission_job
from .pipeline import Stages, build_stages, emission_pipeline, routes_from_trajectory, trajectory_output

R = O.R
P12 = DEFAULT.with_(merge_gap_hours=12.0)
PMONTH = DEFAULT.with_(period="month")
PWIDE = DEFAULT.with_(port_radius_deg=1.0)  # several ports in reach


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to the compared precision."""
    return df.select(*[F.round(F.col(f.name), R).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def stages(spark: SparkSession, sf: str, p: Params = DEFAULT, type_rule: str = "freight",
           vessel: str = "user", nulls: bool = False, irregular: bool = False,
           many_ports: bool = False) -> Stages:
    ev = fx.table(spark, sf, "events")
    nat = fx.table(spark, sf, "nation")
    ports_ = fx.ports_from_supplier(fx.table(spark, sf, "supplier")) if many_ports else fx.ports_from_nation(nat)
    return build_stages(fx.ais_from_events(ev, type_rule, vessel, nulls),
                        fx.irregular_states(nat) if irregular else fx.states_from_nation(nat), ports_, p)


ROW = ["period", "MMSI", "BaseDateTime"]


# --- Spark side ---------------------------------------------------------------

def q_freight_filter(spark, sf):
    ais = fx.ais_from_events(fx.table(spark, sf, "events"), type_rule="mixed")
    as_text = ais.select(*[F.col(c).cast("string").alias(c) for c in ais.columns])
    as_text = as_text.withColumn("VesselType", F.format_string("%.1f", F.col("VesselType").cast("double")))
    out = ingest.ingest(as_text)
    return rounded(out.select("period", "year", "MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType"))


def q_vessel_counts(spark, sf):
    s = stages(spark, sf)
    return metrics.vessel_counts(s.typed)


def q_run_metrics(spark, sf):
    s = stages(spark, sf)
    return metrics.run_metrics(s)


def _smooth_out(s: Stages):
    return rounded(s.smoothed.select(*ROW, "LAT", "LON", "SOG", "n_rows"))


def q_smooth_tracks(spark, sf):
    return _smooth_out(stages(spark, sf))


def q_smooth_gate(spark, sf):
    return _smooth_out(stages(spark, sf, vessel="user_day"))


def q_slow_runs(spark, sf):
    return rounded(tracks.slow_runs(stages(spark, sf).runs))


def q_merged_stops(spark, sf):
    return tracks.merged_stops(stages(spark, sf).runs)


def q_merged_stops_12h(spark, sf):
    return tracks.merged_stops(stages(spark, sf, P12).runs)


def q_collapsed_track(spark, sf):
    return rounded(stages(spark, sf).kept.select(*ROW, "LAT", "LON", "SOG", "VesselType", "Label"))


def q_time_diff(spark, sf):
    return rounded(stages(spark, sf).co2.select(*ROW, "TimeDiff"))


def q_next_point(spark, sf):
    return rounded(stages(spark, sf).co2.select(*ROW, "next_LAT", "next_LON", "next_SOG"))


def q_leg_distance(spark, sf):
    return rounded(stages(spark, sf).co2.select(*ROW, "distance_nm"))


def q_mean_speed(spark, sf):
    return rounded(stages(spark, sf).co2.select(*ROW, "speed_mean"))


def q_vessel_class(spark, sf):
    s = stages(spark, sf)
    return (s.smoothed.filter(F.col("seq") == 1)
            .select("period", "MMSI", "first_type",
                    F.col("first_type").between(DEFAULT.tanker_type_min, DEFAULT.tanker_type_max).alias("tanker")))


def q_stop_emission(spark, sf):
    return rounded(stages(spark, sf).co2.filter(F.col("Label") == "1").select(*ROW, "TimeDiff", "CO2"))


def q_move_emission(spark, sf):
    return rounded(stages(spark, sf).co2.filter(F.col("Label") == "0")
                   .select(*ROW, "distance_nm", "speed_mean", "CO2"))


def q_row_co2(spark, sf):
    return rounded(stages(spark, sf).co2.select(*ROW, "LAT", "LON", "SOG", "VesselType", "Label",
                                                "TimeDiff", "CO2"))


def q_state_tag(spark, sf):
    return stages(spark, sf).states.select(*ROW, "State")


def q_port_tag(spark, sf):
    return rounded(stages(spark, sf).trajectory.select("period", "year", *emissions.TRAJECTORY_COLUMNS))


def q_stays(spark, sf):
    return routes.stays(stages(spark, sf).marked)


def q_stay_pairs(spark, sf):
    return routes.stay_pairs(stages(spark, sf).marked)


ROUTE_OUT = ["period", "MMSI", "year", "start_time", "end_time", "start_port", "start_state",
             "end_port", "end_state", "total_emissions"]


def q_routes(spark, sf):
    return rounded(routes.routes(stages(spark, sf).table).select(*ROUTE_OUT))


# Every vessel above 40 rows is treated as hot and cut into chunks of about
# 16 rows: the chunked scans must give exactly the plain routes.
PSPLIT = DEFAULT.with_(hot_vessel_rows=40, chunk_rows=16)


def q_routes_split(spark, sf):
    return rounded(routes.routes(stages(spark, sf, PSPLIT).table).select(*ROUTE_OUT))


def q_row_co2_split(spark, sf):
    return rounded(stages(spark, sf, PSPLIT).co2.select(*ROW, "LAT", "LON", "SOG", "VesselType", "Label",
                                                        "TimeDiff", "CO2"))


def q_route_state_list(spark, sf):
    return routes.route_state_lists(stages(spark, sf).table).drop("route_key")


TRANSIT_OUT = ["period", "MMSI", "year", "start_time", "state", "emissions"]


def q_transit_emissions(spark, sf):
    return rounded(routes.transit_emissions(stages(spark, sf).table).select(*TRANSIT_OUT))


FLOW_OUT = ["period", "MMSI", "year", "start_time", "source_state", "dest_state", "amount"]


def q_flows(spark, sf):
    t = routes.transit_emissions(stages(spark, sf).table)
    return rounded(routes.transfer_flows(t).select(*FLOW_OUT))


def _transfers(spark, sf, p=DEFAULT):
    t = routes.transit_emissions(stages(spark, sf, p).table)
    return matrix.transfer_long(routes.transfer_flows(t))


def q_transfer_long(spark, sf):
    return rounded(_transfers(spark, sf))


def q_transfer_matrix(spark, sf):
    return rounded(matrix.transfer_matrix(_transfers(spark, sf), fx.STATE_NAMES))


WIDE_KEEP = ["year", "MMSI", "start_time", "start_port", "start_state", "end_port", "end_state", "total_emissions"]


def q_routes_wide(spark, sf):
    return rounded(matrix.wide_routes(stages(spark, sf).table, fx.STATE_NAMES, WIDE_KEEP))


def q_routes_wide_merge(spark, sf):
    """Wide tables of two groups of vessels, the latter with just the states
    they pass, united by name."""
    table = stages(spark, sf, PMONTH).table
    return rounded(matrix.union_wide([
        matrix.wide_routes(table.where("MMSI % 2 = 1"), fx.STATE_NAMES, WIDE_KEEP),
        matrix.wide_routes(table.where("MMSI % 2 = 0"), keep=WIDE_KEEP)]))


def q_smooth_nulls(spark, sf):
    return _smooth_out(stages(spark, sf, nulls=True))


def q_row_co2_nulls(spark, sf):
    return rounded(stages(spark, sf, nulls=True).co2.select(*ROW, "LAT", "LON", "SOG", "Label", "TimeDiff",
                                                            "distance_nm", "speed_mean", "CO2"))


def q_rejects_nulls(spark, sf):
    return stages(spark, sf, vessel="user_day", nulls=True).rejects


def q_routes_nulls(spark, sf):
    return rounded(routes.routes(stages(spark, sf, nulls=True).table).select(*ROUTE_OUT))


def q_nearest_of_many(spark, sf):
    return stages(spark, sf, PWIDE, many_ports=True).trajectory.select(*ROW, "Label", "State", "PortName")


def q_state_tag_irregular(spark, sf):
    return stages(spark, sf, irregular=True).states.select(*ROW, "State")


def q_transit_map(spark, sf):
    """The JSON transit map, parsed again into ordered key / value rows."""
    out = routes.routes_with_state_map(stages(spark, sf).table)
    m = F.from_json("state_emissions_json", "map<string,double>")
    return rounded(out.select("period", "MMSI", "start_time", F.posexplode(F.map_entries(m)).alias("pos", "e"))
                   .select("period", "MMSI", "start_time", "pos", F.col("e.key").alias("state"),
                           F.col("e.value").alias("emissions")))


def q_routes_from_trajectory(spark, sf):
    """Routes from the 11 saved columns alone (step re-entry)."""
    saved = stages(spark, sf).trajectory.select(*emissions.TRAJECTORY_COLUMNS)
    return rounded(routes.routes(routes_from_trajectory(saved)).select(*ROUTE_OUT))


def q_ingest_tally_archives(spark, sf):
    """Days of even number have a file, days whose number 3 divides an archive."""
    ev = fx.table(spark, sf, "events")
    cal = manifest.calendar(ev.select(F.year("ts").alias("year")))
    days = ev.select(F.to_date("ts").alias("day"))
    have = manifest.listing_from_days(days.where(F.dayofmonth("day") % 2 == 0))
    archives = days.select("day", (F.dayofmonth("day") % 3 == 0).alias("has_csv")).distinct()
    return manifest.tally(manifest.ingest_status(cal, have, archives))


# One vessel holds all rows, most of them in one minute.
PBURST = DEFAULT.with_(hot_vessel_rows=100, chunk_rows=200)


def burst_stages(spark, sf, p=PBURST):
    nat = fx.table(spark, sf, "nation")
    ais = fx.ais_from_events(fx.burst_events(fx.table(spark, sf, "events")), vessel="one")
    return build_stages(ais, fx.states_from_nation(nat), fx.ports_from_nation(nat), p)


def q_routes_split_burst(spark, sf):
    return rounded(routes.routes(burst_stages(spark, sf).table).select(*ROUTE_OUT))


def q_row_co2_burst(spark, sf):
    return rounded(burst_stages(spark, sf).co2.select(*ROW, "LAT", "LON", "SOG", "VesselType", "Label", "TimeDiff",
                                                      "CO2"))


def q_period_merge(spark, sf):
    t = routes.transit_emissions(stages(spark, sf, PMONTH).table)
    monthly = routes.transfer_flows(t)
    return rounded(matrix.merge_periods(monthly))


def q_monthly_routes(spark, sf):
    return rounded(routes.routes(stages(spark, sf, PMONTH).table).select(*ROUTE_OUT))


def q_us_ports(spark, sf):
    nat = fx.table(spark, sf, "nation")
    raw = fx.world_ports_from_supplier(fx.table(spark, sf, "supplier"))
    return rounded(ports.build_ports(raw, fx.states_from_nation(nat)))


def _days_with_data(spark, sf):
    ev = fx.table(spark, sf, "events")
    return manifest.listing_from_days(ev.select(F.to_date("ts").alias("day")))


def q_calendar(spark, sf):
    ev = fx.table(spark, sf, "events")
    return manifest.calendar(ev.select(F.year("ts").alias("year")))


def q_missing_days(spark, sf):
    ev = fx.table(spark, sf, "events")
    cal = manifest.calendar(ev.select(F.year("ts").alias("year")))
    return manifest.missing_days(cal, _days_with_data(spark, sf))


def q_ingest_tally(spark, sf):
    ev = fx.table(spark, sf, "events")
    cal = manifest.calendar(ev.select(F.year("ts").alias("year")))
    status = manifest.ingest_status(cal, _days_with_data(spark, sf), None)
    return manifest.tally(status)


def q_rejects(spark, sf):
    return stages(spark, sf).rejects


# --- files and stored tables: written to the shared folder and read back ----------

def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _daily_scan(spark, sf) -> ais_csv.CsvScan:
    """All events as daily CSV files with four headers and faulty lines."""
    return ais_csv.read_ais_csv(spark, fx.write_daily_csv(fx.table(spark, sf, "events"), _folder(spark, "days")))


def _file(path: str = "source_file") -> Column:
    return F.regexp_extract(path, r"(AIS_[0-9_]+\.csv)", 1).alias("file")


DAY_ROW = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType", "Status", "IMO"]


def q_csv_days(spark, sf):
    return rounded(ingest.typed_ais(_daily_scan(spark, sf).rows, extra=["source_file"]).select(*DAY_ROW, _file()))


def q_csv_quarantine(spark, sf):
    return _daily_scan(spark, sf).quarantine.select(_file(), "line", "reason")


def q_csv_report(spark, sf):
    """Per accepted file: lines, rows, quarantined lines and the ingest's counts."""
    scan = _daily_scan(spark, sf)
    split_ = scan.lines.groupBy("source_file").agg(
        F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("quarantined"))
    return (ais_csv.ingest_report(scan.lines).join(split_, "source_file")
            .select(_file(), "rows", "malformed", "no_vessel", "no_time", "dropped", "kept", "quarantined"))


def q_csv_rejects(spark, sf):
    return _daily_scan(spark, sf).rejects.select(
        _file("path"), "reason")


def q_csv_month_glob(spark, sf):
    """Only the files of the month's first nine days, by their names."""
    days = fx.write_daily_csv(fx.table(spark, sf, "events"), _folder(spark, "days"))
    rows = ais_csv.read_ais_csv(spark, days, glob="AIS_*_0[1-9].csv").rows
    return rows.groupBy(_file()).agg(F.count(F.lit(1)).alias("rows"))


def q_zip_days(spark, sf):
    rows, _ = ais_csv.read_zipped_ais(spark, fx.write_daily_zips(fx.table(spark, sf, "events"), _folder(spark, "zips")))
    return rounded(ingest.typed_ais(rows, extra=["member"]).select(*DAY_ROW[:6], "member"))


def q_zip_status(spark, sf):
    _, status = ais_csv.read_zipped_ais(spark, fx.write_daily_zips(fx.table(spark, sf, "events"), _folder(spark, "zips")))
    return status.select("day", "csv_members", "lines", "has_csv")


def q_ingest_manifest(spark, sf):
    """Files of even days and archives of days that 3 divides, as folders."""
    ev = fx.table(spark, sf, "events")
    csv = fx.write_daily_csv(ev.where(F.dayofmonth("ts") % 2 == 0), _folder(spark, "days"))
    zips = fx.write_daily_zips(ev.where(F.dayofmonth("ts") % 3 == 0), _folder(spark, "zips"))
    years = [r[0] for r in ev.select(F.year("ts")).distinct().collect()]
    return manifest.ingest_manifest(spark, csv, years, zips)["tally"]


def q_state_geojson(spark, sf):
    """Polygons read from a GeoJSON file."""
    ev, nat = fx.table(spark, sf, "events"), fx.table(spark, sf, "nation")
    rings = dimensions.read_states_geojson(spark, fx.write_geojson(nat, _folder(spark, "map")), one_feature_per_line=True)
    return build_stages(fx.ais_from_events(ev), rings, fx.ports_from_nation(nat)).states.select(*ROW, "State")


def q_ports_csv(spark, sf):
    """World ports from CSV text, built, written as the port CSV and read again."""
    at = _folder(spark, "ports")
    fx.world_ports_from_supplier(fx.table(spark, sf, "supplier")).write.option("header", True).csv(f"{at}/world")
    built = ports.build_ports(dimensions.read_world_ports(spark, f"{at}/world"),
                              fx.states_from_nation(fx.table(spark, sf, "nation")))
    sinks.write_ports_csv(built, f"{at}/us")
    return rounded(dimensions.read_ports_csv(spark, f"{at}/us").drop("ordinal"))


def month_stages(spark, sf, p=PMONTH) -> Stages:
    """Three months of positions."""
    ev, nat = fx.table(spark, sf, "events"), fx.table(spark, sf, "nation")
    return build_stages(fx.ais_from_events(fx.shifted_events(ev, "DAY", 31)), fx.states_from_nation(nat),
                        fx.ports_from_nation(nat), p)


def q_routes_stored(spark, sf):
    """Routes of three months, written and read back, the map parsed again."""
    at = _folder(spark, "routes")
    sinks.write_routes(month_stages(spark, sf).table, at)
    m = F.map_values(F.from_json("state_emissions", "map<string,double>"))
    return rounded(sinks.stored(spark, at, sinks.ROUTE_SCHEMA).select(
        "year", "period", F.col("mmsi").alias("MMSI"), "start_port", "start_state", "end_port", "end_state",
        "total_emissions", F.aggregate(m, F.lit(0.0), lambda a, x: a + x).alias("transit")))


def q_flows_replaced(spark, sf):
    """Flows of odd vessels, then one month replaced by those of all vessels
    and another by none."""
    at = _folder(spark, "flows")
    flows = routes.transfer_flows(routes.transit_emissions(month_stages(spark, sf).table))
    sinks.write_flows(flows.where("MMSI % 2 = 1"), at)
    sinks.write_flows(flows.where("period = 202402"), at, [202402, 202403])
    back = sinks.stored(spark, at, sinks.FLOW_SCHEMA)
    return rounded(back.groupBy("year", "period", "source_state", "dest_state").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("flows")))


def q_trajectory_stored(spark, sf):
    """Routes from a written trajectory."""
    at = _folder(spark, "trajectory")
    sinks.write_trajectory(trajectory_output(month_stages(spark, sf).trajectory), at)
    return rounded(routes.routes(routes_from_trajectory(dimensions.read_trajectory(spark, at), PMONTH)).select(*ROUTE_OUT))


def q_period_rows(spark, sf):
    """Rows by period and label of a written trajectory, read without a schema."""
    at = _folder(spark, "trajectory")
    sinks.write_trajectory(trajectory_output(month_stages(spark, sf).trajectory), at)
    return dimensions.read_period_outputs(spark, at).groupBy("period", "Label").agg(F.count(F.lit(1)).alias("rows"))


def _job(spark, sf) -> str:
    """The whole job over three years, the first two in a run of their own."""
    nat, out = fx.table(spark, sf, "nation"), _folder(spark, "job")
    ais = fx.ais_from_events(fx.shifted_events(fx.table(spark, sf, "events"), "YEAR", 1))
    first = ais.select(F.min(F.year("BaseDateTime"))).first()[0]
    for years in ([first, first + 1], None):
        run_emission_job(spark, ais, fx.ports_from_nation(nat), fx.states_from_nation(nat), out, years=years)
    return out


def q_job_transfers(spark, sf):
    return rounded(sinks.stored(spark, f"{_job(spark, sf)}/transfers", sinks.TRANSFER_SCHEMA))


def q_job_periods(spark, sf):
    """Done markers of the job with the rows it wrote for each period."""
    out = _job(spark, sf)
    count = lambda t, schema: (sinks.stored(spark, f"{out}/{t}", schema).groupBy("period")
                               .agg(F.count(F.lit(1)).alias(t)))
    return (sinks.stored(spark, f"{out}/done", sinks.DONE_SCHEMA).select("period")
            .join(count("trajectory", sinks.TRAJECTORY_SCHEMA), "period", "left")
            .join(count("routes", sinks.ROUTE_SCHEMA), "period", "left")
            .join(count("flows", sinks.FLOW_SCHEMA), "period", "left"))


def q_pipeline_years(spark, sf):
    """The pipeline itself over three years in one plan."""
    nat = fx.table(spark, sf, "nation")
    ais = fx.ais_from_events(fx.shifted_events(fx.table(spark, sf, "events"), "YEAR", 1))
    out = emission_pipeline(spark, ais, fx.ports_from_nation(nat), fx.states_from_nation(nat),
                            stage_dir=_folder(spark, "stage"))
    return rounded(out["routes"].select(*ROUTE_OUT))


def q_state_tag_dense(spark, sf):
    """Polygons with thousands of edges."""
    nat = fx.table(spark, sf, "nation")
    return build_stages(fx.ais_from_events(fx.table(spark, sf, "events")), fx.dense_states(nat),
                        fx.ports_from_nation(nat)).states.select(*ROW, "State")


def q_smooth_5(spark, sf):
    return _smooth_out(stages(spark, sf, DEFAULT.with_(smooth_window=5), nulls=True))


def q_smooth_7(spark, sf):
    return _smooth_out(stages(spark, sf, DEFAULT.with_(smooth_window=7), nulls=True))


def q_vessels_in_ranges(spark, sf):
    """Distinct vessels of all ranges of months, from the bitmaps kept of each month."""
    at = _folder(spark, "vessels")
    sinks.write_vessel_bitmaps(metrics.vessel_bitmaps(month_stages(spark, sf).typed), at)
    kept = sinks.stored(spark, at, sinks.BITMAP_SCHEMA)
    months = kept.select("period").distinct()
    ranges = months.select(F.col("period").alias("first")).join(
        months.select(F.col("period").alias("last")), F.expr("first <= last"))
    return metrics.vessels_in(kept, ranges)


def q_transfers_incremental(spark, sf):
    """Kept sums of each month, one month of them done again, then the year."""
    at = _folder(spark, "sums")
    sums = matrix.period_sums(routes.transfer_flows(routes.transit_emissions(month_stages(spark, sf).table)))
    sinks.write_period_sums(sums.withColumn("amount", F.when(F.col("period") == 202402, -1.0).otherwise(F.col("amount"))), at)
    sinks.write_period_sums(sums.where("period = 202402"), at, [202402])
    return rounded(matrix.transfer_long(sinks.stored(spark, at, sinks.FLOW_SCHEMA)))


def q_routes_from_stage(spark, sf):
    """Re-entry from a trajectory kept in buckets by vessel."""
    at = _folder(spark, "staged")
    staged.write_staged(trajectory_output(month_stages(spark, sf).trajectory), at, 8)
    return rounded(routes.routes(routes_from_trajectory(staged.read_staged(spark, at), PMONTH, placed=True)).select(*ROUTE_OUT))


def _from_csv(df: DataFrame, text: list[str]) -> DataFrame:
    return rounded(df.select(*[F.col(f"`{c}`") if c in text else F.col(f"`{c}`").cast(
        "long" if c in ("Year", "MMSI") else "double").alias(c) for c in df.columns]))


WIDE_TEXT = ["Start Port", "Start State", "End Port", "End State"]
OUT_STATES = "States with carbon transfer out"


def q_routes_wide_csv(spark, sf):
    at = _folder(spark, "wide")
    sinks.write_routes_wide_csv(stages(spark, sf).table, at, fx.STATE_NAMES)
    return _from_csv(spark.read.option("header", True).csv(at), WIDE_TEXT)


def q_matrix_csv(spark, sf):
    at = _folder(spark, "matrix")
    sinks.write_matrix_csv(_transfers(spark, sf), at, fx.STATE_NAMES)
    return _from_csv(spark.read.option("header", True).csv(at), [OUT_STATES])


def q_routes_from_trajectory_burst(spark, sf):
    """Re-entry with one vessel that holds all rows."""
    saved = burst_stages(spark, sf).trajectory.select(*emissions.TRAJECTORY_COLUMNS)
    return rounded(routes.routes(routes_from_trajectory(saved, PBURST)).select(*ROUTE_OUT))


SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "freight_filter": q_freight_filter,
    "vessel_counts": q_vessel_counts,
    "run_metrics": q_run_metrics,
    "smooth_tracks": q_smooth_tracks,
    "smooth_gate": q_smooth_gate,
    "slow_runs": q_slow_runs,
    "merged_stops": q_merged_stops,
    "merged_stops_12h": q_merged_stops_12h,
    "collapsed_track": q_collapsed_track,
    "time_diff": q_time_diff,
    "next_point": q_next_point,
    "leg_distance": q_leg_distance,
    "mean_speed": q_mean_speed,
    "vessel_class": q_vessel_class,
    "stop_emission": q_stop_emission,
    "move_emission": q_move_emission,
    "row_co2": q_row_co2,
    "state_tag": q_state_tag,
    "port_tag": q_port_tag,
    "stays": q_stays,
    "stay_pairs": q_stay_pairs,
    "routes": q_routes,
    "routes_split": q_routes_split,
    "row_co2_split": q_row_co2_split,
    "route_state_list": q_route_state_list,
    "transit_emissions": q_transit_emissions,
    "flows": q_flows,
    "transfer_long": q_transfer_long,
    "transfer_matrix": q_transfer_matrix,
    "routes_wide": q_routes_wide,
    "period_merge": q_period_merge,
    "monthly_routes": q_monthly_routes,
    "us_ports": q_us_ports,
    "calendar": q_calendar,
    "missing_days": q_missing_days,
    "ingest_tally": q_ingest_tally,
    "rejects": q_rejects,
    "routes_split_burst": q_routes_split_burst,
    "row_co2_burst": q_row_co2_burst,
    "routes_wide_merge": q_routes_wide_merge,
    "smooth_nulls": q_smooth_nulls,
    "row_co2_nulls": q_row_co2_nulls,
    "rejects_nulls": q_rejects_nulls,
    "routes_nulls": q_routes_nulls,
    "nearest_of_many": q_nearest_of_many,
    "state_tag_irregular": q_state_tag_irregular,
    "transit_map": q_transit_map,
    "routes_from_trajectory": q_routes_from_trajectory,
    "ingest_tally_archives": q_ingest_tally_archives,
    "csv_days": q_csv_days,
    "csv_quarantine": q_csv_quarantine,
    "csv_report": q_csv_report,
    "csv_rejects": q_csv_rejects,
    "csv_month_glob": q_csv_month_glob,
    "zip_days": q_zip_days,
    "zip_status": q_zip_status,
    "ingest_manifest": q_ingest_manifest,
    "state_geojson": q_state_geojson,
    "ports_csv": q_ports_csv,
    "routes_stored": q_routes_stored,
    "flows_replaced": q_flows_replaced,
    "trajectory_stored": q_trajectory_stored,
    "period_rows": q_period_rows,
    "job_transfers": q_job_transfers,
    "job_periods": q_job_periods,
    "pipeline_years": q_pipeline_years,
    "routes_wide_csv": q_routes_wide_csv,
    "matrix_csv": q_matrix_csv,
    "routes_from_trajectory_burst": q_routes_from_trajectory_burst,
    "state_tag_dense": q_state_tag_dense,
    "smooth_5": q_smooth_5,
    "smooth_7": q_smooth_7,
    "vessels_in_ranges": q_vessels_in_ranges,
    "transfers_incremental": q_transfers_incremental,
    "routes_from_stage": q_routes_from_stage,
}


# --- DuckDB side -------------------------------------------------------------

def _row(cols: list[str], src: str, where: str = "", doubles: tuple[str, ...] = ()) -> str:
    sel = ", ".join(O._rd(c, c) if c in doubles else c for c in cols)
    return f"SELECT {sel} FROM {src}" + (f" WHERE {where}" if where else "")


def _sql() -> dict[str, str]:
    c = O.with_chain
    rowc = ["period", "MMSI", "BaseDateTime"]
    ais_mixed = O.ais_sql("mixed")
    q: dict[str, str] = {}
    q["freight_filter"] = f"""
      SELECT CAST(year(BaseDateTime) AS INTEGER) AS period, CAST(year(BaseDateTime) AS INTEGER) AS year,
             MMSI, BaseDateTime, round(LAT, {R}) AS LAT, round(LON, {R}) AS LON, round(SOG, {R}) AS SOG,
             VesselType
      FROM ({ais_mixed}) a WHERE VesselType BETWEEN 70 AND 89"""
    q["vessel_counts"] = c("SELECT period, year, count(*) AS records, count(DISTINCT MMSI) AS vessels "
                           "FROM typed GROUP BY period, year")
    q["run_metrics"] = c("""
      SELECT t.period, t.records, t.vessels, k.kept_rows, k.stop_rows, r.routes, f.flows
      FROM (SELECT period, count(*) AS records, count(DISTINCT MMSI) AS vessels FROM typed GROUP BY period) t
      LEFT JOIN (SELECT period, count(*) AS kept_rows, count(*) FILTER (WHERE Label = '1') AS stop_rows
                 FROM accepted GROUP BY period) k ON t.period = k.period
      LEFT JOIN (SELECT period, count(*) AS routes FROM routes GROUP BY period) r ON t.period = r.period
      LEFT JOIN (SELECT period, count(*) AS flows FROM flows GROUP BY period) f ON t.period = f.period""")
    sm = _row(rowc + ["LAT", "LON", "SOG", "n_rows"], "smoothed", doubles=("LAT", "LON", "SOG"))
    q["smooth_tracks"] = c(sm)
    q["smooth_gate"] = c(sm, vessel="user_day")
    q["slow_runs"] = c(f"SELECT period, MMSI, start_time, end_time, n_rows, "
                       f"round(CAST(us AS DOUBLE) / CAST(3600000000 AS DOUBLE), {R}) AS hours, qualified FROM runs")
    ms = "SELECT period, MMSI, start_time, end_time, n_runs FROM stops"
    q["merged_stops"] = c(ms)
    q["merged_stops_12h"] = c(ms, P12)
    q["collapsed_track"] = c(_row(rowc + ["LAT", "LON", "SOG", "VesselType", "Label"], "kept",
                                  doubles=("LAT", "LON", "SOG")))
    q["time_diff"] = c(_row(rowc + ["TimeDiff"], "co2", doubles=("TimeDiff",)))
    q["next_point"] = c(_row(rowc + ["next_LAT", "next_LON", "next_SOG"], "co2",
                             doubles=("next_LAT", "next_LON", "next_SOG")))
    q["leg_distance"] = c(_row(rowc + ["distance_nm"], "co2", doubles=("distance_nm",)))
    q["mean_speed"] = c(_row(rowc + ["speed_mean"], "co2", doubles=("speed_mean",)))
    q["vessel_class"] = c("SELECT period, MMSI, first_type, first_type BETWEEN 80 AND 89 AS tanker "
                          "FROM smoothed WHERE seq = 1")
    q["stop_emission"] = c(_row(rowc + ["TimeDiff", "CO2"], "co2", "Label = '1'", ("TimeDiff", "CO2")))
    q["move_emission"] = c(_row(rowc + ["distance_nm", "speed_mean", "CO2"], "co2", "Label = '0'",
                                ("distance_nm", "speed_mean", "CO2")))
    q["row_co2"] = c(_row(rowc + ["LAT", "LON", "SOG", "VesselType", "Label", "TimeDiff", "CO2"], "co2",
                          doubles=("LAT", "LON", "SOG", "TimeDiff", "CO2")))
    q["row_co2_split"] = q["row_co2"]
    q["state_tag"] = c("SELECT period, MMSI, BaseDateTime, poly_state AS State FROM traj")
    q["port_tag"] = c(_row(["period", "year", "MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType",
                            "Label", "TimeDiff", "CO2", "State", "PortName"], "traj",
                           doubles=("LAT", "LON", "SOG", "TimeDiff", "CO2")))
    q["stays"] = c("SELECT period, MMSI, year, start_time, port, state FROM starts")
    q["stay_pairs"] = c("SELECT period, MMSI, year, start_time, end_time, start_port, start_state, "
                        "end_port, end_state FROM pairs")
    q["routes"] = c(_row(ROUTE_OUT, "routes", doubles=("total_emissions",)))
    q["routes_split"] = q["routes"]
    q["route_state_list"] = c("""
      SELECT period, MMSI, year, start_time, string_agg(DISTINCT row_state, ',' ORDER BY row_state) AS states
      FROM route_rows WHERE row_state IS NOT NULL GROUP BY period, MMSI, year, start_time""")
    q["transit_emissions"] = c(_row(TRANSIT_OUT, "transit", doubles=("emissions",)))
    q["flows"] = c(_row(FLOW_OUT, "flows", doubles=("amount",)))
    q["transfer_long"] = c(_row(["year", "source_state", "dest_state", "amount"], "transfers",
                                doubles=("amount",)))
    per_state = lambda value, col: ", ".join(  # noqa: E731  one column a state, gaps 0
        f"coalesce(round(sum({value}) FILTER (WHERE {col} = '{n}'), {R}), 0) AS \"{n}\"" for n in fx.STATE_NAMES)
    q["transfer_matrix"] = c(f"SELECT year, source_state, {per_state('amount', 'dest_state')} "
                             "FROM transfers GROUP BY year, source_state")
    wide = f"""
      SELECT r.year, r.MMSI, r.start_time, r.start_port, r.start_state, r.end_port, r.end_state,
             round(any_value(r.total_emissions), {R}) AS total_emissions, {per_state('t.emissions', 't.state')}
      FROM routes r LEFT JOIN transit t ON t.period = r.period AND t.MMSI = r.MMSI AND t.start_time = r.start_time
      GROUP BY r.period, r.year, r.MMSI, r.start_time, r.end_time, r.start_port, r.start_state, r.end_port,
               r.end_state"""
    q["routes_wide"] = c(wide)
    q["routes_wide_merge"] = c(wide, PMONTH)
    burst_ = {"vessel": "one", "events": O.BURST}
    q["routes_split_burst"] = c(_row(ROUTE_OUT, "routes", doubles=("total_emissions",)), **burst_)
    q["row_co2_burst"] = c(_row(rowc + ["LAT", "LON", "SOG", "VesselType", "Label", "TimeDiff", "CO2"], "co2",
                                doubles=("LAT", "LON", "SOG", "TimeDiff", "CO2")), **burst_)
    q["smooth_nulls"] = c(sm, nulls=True)
    q["row_co2_nulls"] = c(_row(rowc + ["LAT", "LON", "SOG", "Label", "TimeDiff", "distance_nm", "speed_mean", "CO2"],
                                "co2", doubles=("LAT", "LON", "SOG", "TimeDiff", "distance_nm", "speed_mean", "CO2")),
                           nulls=True)
    q["routes_nulls"] = c(_row(ROUTE_OUT, "routes", doubles=("total_emissions",)), nulls=True)
    q["nearest_of_many"] = c(_row(rowc + ["Label", "State", "PortName"], "traj"), PWIDE, ports=O.SUPPLIER_PORTS)
    q["state_tag_irregular"] = c("SELECT period, MMSI, BaseDateTime, poly_state AS State FROM traj",
                                 inside=O.IRREGULAR)
    q["transit_map"] = c(f"""
      SELECT period, MMSI, start_time, CAST(row_number() OVER (PARTITION BY period, MMSI, start_time
               ORDER BY first_seq) - 1 AS INTEGER) AS pos, state, round(emissions, {R}) AS emissions
      FROM (SELECT period, MMSI, start_time, row_state AS state, sum(row_co2) AS emissions, min(row_seq) AS first_seq
            FROM route_rows
            WHERE row_state IS NOT NULL AND row_state <> start_state AND row_state <> end_state
            GROUP BY period, MMSI, start_time, row_state HAVING sum(row_co2) > 0)""")
    q["routes_from_trajectory"] = q["routes"]
    q["period_merge"] = c(_row(["year", "source_state", "dest_state", "amount"], "transfers",
                               doubles=("amount",)), PMONTH)
    q["monthly_routes"] = c(_row(ROUTE_OUT, "routes", doubles=("total_emissions",)), PMONTH)
    q["us_ports"] = f"""
      WITH wp AS (
        SELECT s_name AS port_name, CAST(2500 + (s_suppkey * 37) % 1000 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
               CAST(-9500 + (s_suppkey * 53) % 1000 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon,
               CASE s_nationkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN ' us ' ELSE 'CA' END AS country
        FROM supplier),
      boxes AS (
        SELECT n_name AS name, CAST(-95 + 2 * (n_nationkey % 5) AS DOUBLE) AS x0,
               CAST(25 + 2 * (n_nationkey // 5) AS DOUBLE) AS y0 FROM nation)
      SELECT w.port_name AS "Main Port Name", b.name AS state, round(w.lat, {R}) AS "Latitude",
             round(w.lon, {R}) AS "Longitude"
      FROM wp w JOIN boxes b ON w.lon BETWEEN b.x0 AND b.x0 + 2 AND w.lat BETWEEN b.y0 AND b.y0 + 2
      WHERE upper(trim(w.country)) = 'US'"""
    cal = O.calendar_sql()
    q["calendar"] = cal + "\nSELECT year, day, file_stem FROM named"
    present = "(SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)"
    q["missing_days"] = cal + f"\nSELECT n.year, n.day, n.file_stem FROM named n ANTI JOIN {present} p ON n.day = p.day"
    q["ingest_tally"] = cal + f"""
      SELECT CASE WHEN p.day IS NOT NULL THEN 'SKIPPED' ELSE 'FAILED' END AS status, count(*) AS files
      FROM named n LEFT JOIN {present} p ON n.day = p.day GROUP BY 1"""
    q["ingest_tally_archives"] = cal + """
      , e AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
      SELECT CASE WHEN day(e.day) % 2 = 0 THEN 'SKIPPED' WHEN day(e.day) % 3 = 0 THEN 'SUCCESS' ELSE 'FAILED' END
               AS status, count(*) AS files
      FROM named n LEFT JOIN e ON n.day = e.day GROUP BY 1"""
    rejects = """
      SELECT period, MMSI, count(*) AS rows,
             count(*) FILTER (WHERE Label = '1' AND (LAT IS NULL OR LON IS NULL)) AS stop_rows_without_position,
             'stop row without coordinates' AS reason
      FROM co2 WHERE (period, MMSI) IN (SELECT (period, MMSI) FROM rejected) GROUP BY period, MMSI"""
    q["rejects"] = c(rejects)
    days = O.daily_sql(fx.DAILY_HEADERS)
    q["csv_days"] = days + f"""
      SELECT MMSI, BaseDateTime, round(LAT, {R}) AS LAT, round(LON, {R}) AS LON, round(SOG, {R}) AS SOG,
        CAST(VesselType AS DOUBLE) AS VesselType, CASE WHEN variant = 2 THEN '5' END AS Status,
        CASE WHEN variant = 1 THEN 'IMO' || MMSI END AS IMO, file
      FROM lines WHERE reason IS NULL"""
    q["csv_quarantine"] = days + "\nSELECT file, line, reason FROM lines WHERE reason IS NOT NULL"
    # a line that is cut off still has what stands before the cut
    q["csv_report"] = days + """
      SELECT file, count(*) AS rows, count(*) FILTER (WHERE k IN (7, 13)) AS malformed,
        count(*) FILTER (WHERE no_vessel) AS no_vessel, count(*) FILTER (WHERE no_time) AS no_time,
        count(*) FILTER (WHERE no_vessel OR no_time) AS dropped, count(*) FILTER (WHERE reason IS NULL) AS kept,
        count(*) FILTER (WHERE reason IS NOT NULL) AS quarantined
      FROM (SELECT *, k = 29 OR (k = 13 AND variant = 1) AS no_vessel, k = 21 OR (k = 13 AND variant = 1) AS no_time FROM lines)
      GROUP BY file"""
    q["csv_rejects"] = days + f"""
      SELECT DISTINCT file, 'missing columns VesselType; found {', '.join(fx.DAILY_HEADERS[3])}' AS reason
      FROM all_lines WHERE variant = 3"""
    q["csv_month_glob"] = days + "\nSELECT file, count(*) AS rows FROM lines WHERE reason IS NULL AND day(day) < 10 GROUP BY file"
    q["zip_days"] = f"""
      SELECT MMSI, BaseDateTime, round(LAT, {R}) AS LAT, round(LON, {R}) AS LON, round(SOG, {R}) AS SOG,
        CAST(VesselType AS DOUBLE) AS VesselType,
        strftime(BaseDateTime, 'AIS_%Y_%m_%d_') || (MMSI % 8) || '.csv' AS member
      FROM ({O.ais_sql()}) a"""
    q["zip_status"] = """
      SELECT CAST(ts AS DATE) AS day, CAST(count(DISTINCT user_id % 8) AS INTEGER) AS csv_members, count(*) AS lines,
        true AS has_csv FROM events GROUP BY 1"""
    q["ingest_manifest"] = q["ingest_tally_archives"]
    q["state_geojson"] = q["state_tag"]
    q["ports_csv"] = (f"SELECT \"Main Port Name\" AS name, state, round(\"Latitude\", {R}) AS lat, "
                      f"round(\"Longitude\", {R}) AS lon FROM ({q['us_ports']})")
    months = {"p": PMONTH, "events": O.shifted_sql("to_days", 31)}
    q["routes_stored"] = c(f"""
      SELECT r.year, r.period, r.MMSI, r.start_port, r.start_state, r.end_port, r.end_state,
        round(any_value(r.total_emissions), {R}) AS total_emissions, round(sum(t.emissions), {R}) AS transit
      FROM routes r LEFT JOIN transit t ON t.period = r.period AND t.MMSI = r.MMSI AND t.start_time = r.start_time
      GROUP BY r.year, r.period, r.MMSI, r.start_time, r.start_port, r.start_state, r.end_port, r.end_state""", **months)
    q["flows_replaced"] = c(f"""
      SELECT year, period, source_state, dest_state, round(sum(amount), {R}) AS amount, count(*) AS flows
      FROM flows WHERE period = 202402 OR (period <> 202403 AND MMSI % 2 = 1)
      GROUP BY year, period, source_state, dest_state""", **months)
    q["trajectory_stored"] = c(_row(ROUTE_OUT, "routes", doubles=("total_emissions",)), **months)
    q["period_rows"] = c("SELECT period, Label, count(*) AS rows FROM traj GROUP BY period, Label", **months)
    years = {"events": O.shifted_sql("to_years", 1)}
    q["job_transfers"] = c(_row(["year", "source_state", "dest_state", "amount"], "transfers", doubles=("amount",)), **years)
    q["job_periods"] = c("""
      SELECT t.period, t.trajectory, r.routes, f.flows
      FROM (SELECT period, count(*) AS trajectory FROM traj GROUP BY period) t
      LEFT JOIN (SELECT period, count(*) AS routes FROM routes GROUP BY period) r ON t.period = r.period
      LEFT JOIN (SELECT period, count(*) AS flows FROM flows GROUP BY period) f ON t.period = f.period""", **years)
    q["pipeline_years"] = c(_row(ROUTE_OUT, "routes", doubles=("total_emissions",)), **years)
    states = ", ".join(f'"{n}"' for n in fx.STATE_NAMES)
    q["routes_wide_csv"] = f"""
      SELECT CAST(year AS BIGINT) AS "Year", MMSI, start_port AS "Start Port", start_state AS "Start State",
        end_port AS "End Port", end_state AS "End State", total_emissions AS "Total Emissions", {states}
      FROM ({q["routes_wide"]})"""
    q["matrix_csv"] = f"""
      SELECT CAST(year AS BIGINT) AS "Year", source_state AS "{OUT_STATES}", {states} FROM ({q["transfer_matrix"]})"""
    q["routes_from_trajectory_burst"] = q["routes_split_burst"]
    q["state_tag_dense"] = c("SELECT period, MMSI, BaseDateTime, poly_state AS State FROM traj", inside=O.DENSE)
    q["smooth_5"] = c(sm, DEFAULT.with_(smooth_window=5), nulls=True)
    q["smooth_7"] = c(sm, DEFAULT.with_(smooth_window=7), nulls=True)
    q["vessels_in_ranges"] = c("""
      SELECT a.period AS first, b.period AS last, count(DISTINCT t.MMSI) AS vessels
      FROM (SELECT DISTINCT period FROM typed) a JOIN (SELECT DISTINCT period FROM typed) b ON a.period <= b.period
      JOIN typed t ON t.period BETWEEN a.period AND b.period GROUP BY a.period, b.period""", **months)
    q["transfers_incremental"] = c(_row(["year", "source_state", "dest_state", "amount"], "transfers", doubles=("amount",)),
                                   **months)
    q["routes_from_stage"] = q["trajectory_stored"]
    q["rejects_nulls"] = c(rejects, vessel="user_day", nulls=True)
    return q


ORACLE: dict[str, str] = _sql()
