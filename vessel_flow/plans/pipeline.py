"""The whole pipeline as one lazy plan.

``build_stages`` returns every intermediate as a lazy DataFrame; nothing runs
until an output is consumed, and each consumer only pays for the stages it
reads.  The plan has one hash exchange on (period, MMSI) ahead of all
windows; the geometry joins are broadcast cell joins that keep that
partitioning; routes and transit states come from aggregations keyed by
(period, MMSI, route_key), which reuse it too.  Only the final transfer sum
by state pair shuffles again (a small, partially aggregated shuffle).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks
from ..operators import emissions, geo, ingest, matrix, metrics, routes, split, tracks
from ..params import DEFAULT, Params

TRAJECTORY_COLUMNS = emissions.TRAJECTORY_COLUMNS


STAGE_NAMES = ("ingested", "smoothed", "runs", "stops", "kept", "co2", "accepted", "rejects", "states",
               "trajectory", "marked_all", "marked", "table")


class Stages:
    """Every stage of the pipeline as a lazy DataFrame, built on first use:
    a query that reads ``smoothed`` never builds (or checks the broadcast
    size of) the geometry tables.

    typed      typed, filtered, keyed rows before any shuffle
    ingested   the same rows hash-partitioned by vessel
    smoothed   + seq, n_rows, first_type, smoothed LAT/LON/SOG
    runs       + slow-run marks (ascending pass)
    stops      + stop marks, all rows (descending pass)
    kept       stop interiors dropped
    co2        + TimeDiff, next point, CO2, rejected
    accepted   co2 rows of vessels that are not rejected
    rejects    one row per rejected vessel
    states     + State from polygons
    trajectory + port match: the enriched trajectory (all columns)
    marked     + stays and route keys
    table      one row per route, with the transit array
    """

    def __init__(self, params: Params, builders: dict, persisted: list | None = None):
        self.params = params
        self._builders = builders
        self._built: dict[str, DataFrame] = {}
        self.persisted = persisted or []

    def __getattr__(self, name):
        builders = self.__dict__.get("_builders", {})
        if name not in builders:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = builders[name](self)
        return self._built[name]

    def release(self) -> None:
        for df in self.persisted:
            df.unpersist()


def build_stages(ais: DataFrame, state_rings: DataFrame, ports: DataFrame,
                 p: Params = DEFAULT) -> Stages:
    """All stages as lazy DataFrames.

    With ``p.split_hot`` a pre-pass counts rows per vessel-period (a partial
    aggregate of two columns); if some vessel-period is hot, the plan splits
    it into time chunks (see ``operators.split``), otherwise the plain plan
    runs unchanged."""
    ing0 = ingest.ingest(ais, p)
    # built and size-checked when first read, shared by all joins of the run
    cells = Stages(p, {
        "states": lambda s: geo.bounded_broadcast(geo.state_cells(state_rings, p), p, geo.state_bytes(state_rings, p)),
        "ports": lambda s: geo.bounded_broadcast(geo.port_cells(ports, p), p, geo.port_bytes(ports, p))})
    out = None
    if p.split_hot:
        hot = split.hot_vessels(split.vessel_stats(ing0), p)
        if hot is not None:
            out = _split_stages(ing0, hot, cells, p)
    if out is None:
        out = _plain_stages(ingest.partition_by_vessel(ing0, n=p.track_partitions), cells, p)
    out.typed = ing0  # typed, filtered rows before the vessel exchange (for counts)
    return out


def _plain_stages(ing: DataFrame, cells: Stages, p: Params) -> Stages:
    return Stages(p, {
        "ingested": lambda s: ing,
        "smoothed": lambda s: tracks.smooth_tracks(s.ingested, p),
        "runs": lambda s: tracks.mark_runs(s.smoothed, p),
        "stops": lambda s: tracks.mark_stops(s.runs),
        "kept": lambda s: s.stops.filter(F.col("keep")),
        "co2": lambda s: emissions.estimate_co2(s.kept, p),
        "accepted": lambda s: emissions.split_rejects(s.co2)[0],
        "rejects": lambda s: emissions.split_rejects(s.co2)[1],
        # geometry and stays run on all rows; a rejected vessel is one whole
        # window partition, so dropping it afterwards changes no other vessel
        "states_all": lambda s: geo.tag_states(s.co2, cells.states, p),
        "trajectory_all": lambda s: geo.match_ports(s.states_all, cells.ports, p),
        "marked_all": lambda s: routes.mark_stays(s.trajectory_all),
        "states": lambda s: s.states_all.filter(~F.col("rejected")),
        "trajectory": lambda s: s.trajectory_all.filter(~F.col("rejected")),
        "marked": lambda s: s.marked_all.filter(~F.col("rejected")),
        "table": lambda s: routes.route_table(s.marked),
    })


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b.select(*a.columns))


def _split_stages(ing0: DataFrame, hot: DataFrame, cells: Stages, p: Params) -> Stages:
    """Rows are told apart before any shuffle (a broadcast join on the hot
    vessel-periods): ordinary vessels take the plain plan with its exchange on
    (period, MMSI); hot vessels take the chunked rounds, each of which runs
    when a stage that needs it is first read."""
    marked = split.mark_hot(ing0, hot)
    cold = ingest.partition_by_vessel(marked.filter(~F.col("hot")).drop("hot", "n_total"), n=p.track_partitions)
    c = _plain_stages(cold, cells, p)
    h = split.HotStages(marked.filter(F.col("hot")).drop("hot"), hot, p)
    accepted = lambda df: df.filter(~F.col("rejected"))
    hot_part = Stages(p, {
        "ingested": lambda s: h.ingested,
        "smoothed": lambda s: h.smoothed,
        "runs": lambda s: h.runs,
        "stops": lambda s: h.stops,
        "kept": lambda s: h.kept,
        "co2": lambda s: h.co2,
        "accepted": lambda s: emissions.split_rejects(s.co2)[0],
        "rejects": lambda s: emissions.split_rejects(s.co2)[1],
        "states_all": lambda s: geo.tag_states(s.co2, cells.states, p),
        "trajectory_all": lambda s: geo.match_ports(s.states_all, cells.ports, p),
        "marked_all": lambda s: split.hot_stays(s.trajectory_all, h.persisted),
        "states": lambda s: accepted(s.states_all),
        "trajectory": lambda s: accepted(s.trajectory_all),
        "marked": lambda s: accepted(s.marked_all),
        "table": lambda s: routes.route_table(s.marked, split.VKEY),
    })
    return Stages(p, {name: (lambda s, n=name: _union(getattr(c, n), getattr(hot_part, n))) for name in STAGE_NAMES},
                  h.persisted)


def trajectory_output(traj: DataFrame) -> DataFrame:
    """The enriched trajectory in the reference's column order (+ keys and
    ``seq``, from which routes can be computed again).  A column that the
    input lacks is null (P8)."""
    types = dict(c.split() for c in sinks.TRAJECTORY_SCHEMA.split(", "))
    return traj.select(*[F.col(c) if c in traj.columns else F.lit(None).cast(types[c]).alias(c)
                         for c in ("period", "year", *TRAJECTORY_COLUMNS, "seq")])


def routes_from_trajectory(traj: DataFrame, p: Params = DEFAULT, placed: bool = False) -> DataFrame:
    """The route table from a saved trajectory in the 11-column schema.
    Keys are derived from the time, ``seq`` from the sort order where absent.

    Vessel-periods above ``hot_vessel_rows`` rows go through the chunked rounds,
    as in ``build_stages``: numbered by slices, stays resolved across chunks.
    A ``placed`` trajectory lies in buckets by vessel (``sources.staged``) and is
    not dealt out again."""
    if "period" not in traj.columns:
        traj = traj.select(*ingest.period_columns(F.col("BaseDateTime"), p.period), *traj.columns)
    hot = split.hot_vessels(split.vessel_stats(traj), p) if p.split_hot else None
    if hot is None:
        return _plain_routes(traj, p, placed)
    marked = split.mark_hot(traj, hot)
    cold = _plain_routes(marked.where(~F.col("hot")).drop("hot", "n_total"), p, placed)
    bag: list[DataFrame] = []
    rows = marked.where("hot").drop("hot")
    rows = (rows.withColumn("chunk", split.chunk_of(F.col("seq"), p)) if "seq" in traj.columns
            else split.numbered(rows, hot, p, bag))
    table = routes.route_table(split.hot_stays(rows.drop("n_total"), bag), split.VKEY)
    return _union(cold, table)


def _plain_routes(traj: DataFrame, p: Params, placed: bool) -> DataFrame:
    if not placed:
        traj = ingest.partition_by_vessel(traj, n=p.track_partitions)
    if "seq" not in traj.columns:
        order = [F.col(c).asc_nulls_last() for c in ("BaseDateTime", "LAT", "LON", "SOG", "VesselType")]
        traj = traj.withColumn("seq", F.row_number().over(Window.partitionBy(*ingest.KEY).orderBy(*order)))
    return routes.route_table(routes.mark_stays(traj))


def emission_pipeline(spark: SparkSession, ais: DataFrame, ports: DataFrame, state_rings: DataFrame,
                      p: Params = DEFAULT, stage_dir: str | None = None,
                      periods: list[int] | None = None) -> dict[str, DataFrame]:
    """All outputs of one run: trajectory, routes (with state map), transit
    states, flows, transfer sums, rejects and the vessels' bitmaps.

    ``periods`` selects the input's periods, in every mode.  The route table
    is persisted (one row per route, small) because four outputs read it.
    With ``stage_dir`` (a shared folder) every kept row is written there with
    its vessel's ``rejected`` flag, partitioned by period, and the outputs are
    computed from the written copy of this run's periods: lineage is cut and a
    lost executor only costs the tasks after that point."""
    if periods is not None:
        ais = ingest.only_periods(ais, periods, p)
    s = build_stages(ais, state_rings, ports, p)
    marked, rejects = s.marked, s.rejects
    if stage_dir:
        if periods is None:
            periods = sorted(r["period"] for r in s.typed.select("period").distinct().collect())
        names = [f.name for f in s.marked_all.schema.fields]
        sinks.replace_periods(s.marked_all, stage_dir, periods)
        # no re-partitioning by vessel: the route sums aggregate partially
        # per input split and shuffle only (route, state) partials, so a hot
        # vessel's routes spread over many tasks
        staged = (sinks.stored(spark, stage_dir, s.marked_all.schema)
                  .where(F.col("period").isin([int(x) for x in periods])).select(*names))
        marked = staged.filter(~F.col("rejected"))
        rejects = emissions.split_rejects(staged)[1]
    table = (routes.route_table(marked) if stage_dir else s.table).persist(StorageLevel.MEMORY_AND_DISK)
    transit = routes.transit_emissions(table)
    flows = routes.transfer_flows(transit)
    return {
        "trajectory": trajectory_output(marked),
        "routes": routes.routes_with_state_map(table),
        "transit": transit,
        "flows": flows,
        "transfers": matrix.transfer_long(flows),
        "rejects": rejects,
        "vessels": metrics.vessel_bitmaps(s.typed),
        "route_table": table,
    }
