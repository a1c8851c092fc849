"""Sinks (K1-K9).  Parquet outputs are partitioned by year (and period); a
write names its periods and replaces exactly their rows in one switch, also
where the new result is smaller or empty (see ``versions``); ``stored`` reads
them.  Wide CSV forms keep the reference's headers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions
from .operators import matrix, routes as R
from .session import cut_lineage

#: A folder, or a table of a run that is committed later.
Target = str | tuple[versions.Run, str]

ROUTE_SCHEMA = ("year int, period int, mmsi long, start_port string, start_state string, end_port string, "
                "end_state string, total_emissions double, state_emissions string")
FLOW_SCHEMA = "year int, period int, source_state string, dest_state string, amount double"
BITMAP_SCHEMA = "period int, bucket long, vessels binary"
TRANSFER_SCHEMA = "year int, source_state string, dest_state string, amount double"
TRAJECTORY_SCHEMA = ("period int, year int, seq int, MMSI long, BaseDateTime timestamp_ntz, LAT double, LON double, "
                     "SOG double, VesselType int, Label string, TimeDiff double, CO2 double, State string, "
                     "PortName string")
REJECT_SCHEMA = "period int, MMSI long, rows long, stop_rows_without_position long, reason string"
DONE_SCHEMA = "period int, finished_at timestamp"


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The live rows of a table of these sinks (see ``versions``): of a folder
    with its own version record, or of a table of the folder above it.  A plain
    folder of Parquet files is read as it is.  No rows where nothing was ever
    written (None without a schema)."""
    path = path.rstrip("/")
    top, _, table = path.rpartition("/")
    for root, name in ((path, ""), (top, table)):
        found = versions.Store(spark, root).read(name, schema)
        if found is not None:
            return found
    try:
        return (spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema) if schema else None


def replace_periods(df: DataFrame, target: Target, periods: list[int] | None = None, key: str = "period",
                    parts: list[str] | None = None) -> None:
    """Replaces the rows of all ``periods`` (default: those in ``df``), also of
    those that have no row any more, by ``df``, partitioned by ``parts``.

    With a folder's path as ``target`` this is a run of its own: readers see
    the old rows until all new ones are written.  With (run, table) the rows
    belong to a larger run and show when that one is committed."""
    if periods is None:
        df = cut_lineage(df)  # read for its periods and for the write, computed once
        periods = [r[0] for r in df.select(key).distinct().collect()]  # a handful a year
    if not isinstance(target, str):
        run, table = target
        run.write(df, periods, table, key, parts)
        return
    store = versions.Store(df.sparkSession, target)
    run = store.begin()
    run.write(df, periods, "", key, parts)
    run.commit()
    store.vacuum()


def write_routes(route_table: DataFrame, path: Target, periods: list[int] | None = None) -> None:
    """K1: routes, long form; the transit map as JSON text (null if none)."""
    out = R.routes_with_state_map(route_table).select(
        "year", "period", F.col("MMSI").alias("mmsi"), "start_port", "start_state", "end_port", "end_state",
        "total_emissions", F.col("state_emissions_json").alias("state_emissions"))
    replace_periods(out, path, periods, parts=["year", "period"])


def write_transfers(transfers: DataFrame, path: Target, years: list[int] | None = None) -> None:
    """K2: summed transfers (year, source_state, dest_state, amount).

    A year's partition is replaced as a whole, so ``transfers`` must cover
    whole years; month-by-month runs merge the stored flows first
    (``plans.job.run_emission_job`` does)."""
    replace_periods(transfers.select("year", "source_state", "dest_state", "amount"), path, years, key="year")


def write_flows(flows: DataFrame, path: Target, periods: list[int] | None = None) -> None:
    """K4: raw (unsummed) flows per period, for a later merge."""
    replace_periods(flows.select("year", "period", "source_state", "dest_state", "amount"), path, periods,
                    parts=["year", "period"])


def write_period_sums(sums: DataFrame, path: Target, periods: list[int] | None = None) -> None:
    """Partial transfer sums by period (``matrix.period_sums``), for C9."""
    replace_periods(sums.select("year", "period", "source_state", "dest_state", "amount"), path, periods,
                    parts=["year", "period"])


def write_vessel_bitmaps(bitmaps: DataFrame, path: Target, periods: list[int] | None = None) -> None:
    """The vessels of each period as bitmaps (``metrics.vessel_bitmaps``), for A5."""
    replace_periods(bitmaps, path, periods)


def write_trajectory(traj: DataFrame, path: Target, periods: list[int] | None = None) -> None:
    """K7: the trajectory of accepted vessels, partitioned by period."""
    replace_periods(traj, path, periods)


def write_rejects(rejects: DataFrame, path: Target, periods: list[int] | None = None) -> None:
    """One row per rejected vessel."""
    replace_periods(rejects, path, periods)


def _csv(df: DataFrame, path: str, single_file: bool) -> None:
    if single_file:  # only for tables bounded by the state list, e.g. the matrix
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", True).csv(path)


def write_routes_wide_csv(route_table: DataFrame, path: str, states: list[str] | None = None) -> None:
    """K5: Year, MMSI, Start Port, Start State, End Port, End State, Total
    Emissions, then one column per transit state (sorted, gaps 0)."""
    wide = matrix.wide_routes(route_table, states)
    fixed = {"year": "Year", "MMSI": "MMSI", "start_port": "Start Port", "start_state": "Start State",
             "end_port": "End Port", "end_state": "End State", "total_emissions": "Total Emissions"}
    _csv(wide.withColumnsRenamed(fixed), path, single_file=False)


def write_matrix_csv(transfers: DataFrame, path: str, dests: list[str] | None = None) -> None:
    """K6: Year, 'States with carbon transfer out', one column per destination."""
    m = matrix.transfer_matrix(transfers, dests)
    _csv(m.withColumnsRenamed({"year": "Year", "source_state": "States with carbon transfer out"}), path,
         single_file=True)


def write_ports_csv(ports: DataFrame, path: str) -> None:
    """K8: the port dimension (Main Port Name, state, Latitude, Longitude)."""
    _csv(ports.select("Main Port Name", "state", "Latitude", "Longitude"), path, single_file=True)


def mark_done(spark: SparkSession, periods: list[int], path: str) -> None:
    """K9: one marker row per finished period, written after its outputs,
    even when the period produced no route (R-Q12)."""
    df = spark.createDataFrame([(int(p),) for p in periods], "period int").withColumn(
        "finished_at", F.current_timestamp())
    df.write.mode("append").parquet(path)


def pending_periods(spark: SparkSession, wanted: DataFrame, done_path: str) -> DataFrame:
    """Periods still to run: wanted ``left_anti`` the done markers (K9)."""
    return wanted.join(stored(spark, done_path, DONE_SCHEMA).select("period").distinct(), "period", "left_anti")
