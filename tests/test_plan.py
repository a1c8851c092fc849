"""Physical plan shape of the pipeline."""

import re

from vessel_flow.operators import matrix, routes
from vessel_flow.plans.queries import stages

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_two_sorts_before_route_aggregates(spark):
    s = stages(spark, SF)
    plan = plan_of(routes.routes(s.table))
    track_side = [l for l in plan.splitlines() if "hashpartitioning(period" in l]
    assert len(track_side) == 1, plan                      # the only shuffle of track rows
    assert "REPARTITION_BY_NUM" in track_side[0]             # not coalesced by AQE
    sorts = re.findall(r"Sort \[period#\d+ ASC NULLS FIRST, MMSI#\d+L? ASC NULLS FIRST", plan)
    assert len(sorts) == 2, plan                           # ascending pass + descending pass
    assert "SortAggregate" not in plan
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert plan.count("BroadcastHashJoin") >= 2             # state and port cell joins


def test_no_python_in_pipeline(spark):
    s = stages(spark, SF)
    for df in (s.trajectory, s.table, routes.routes_with_state_map(s.table), s.rejects,
               matrix.transfer_long(routes.transfer_flows(routes.transit_emissions(s.table)))):
        plan = plan_of(df)
        assert "Python" not in plan and "ArrowEval" not in plan and "BatchEval" not in plan


def test_transfer_sum_is_partial_then_final(spark):
    s = stages(spark, SF)
    t = routes.transit_emissions(s.table)
    plan = plan_of(matrix.transfer_long(routes.transfer_flows(t)))
    assert "partial_sum" in plan
    assert "hashpartitioning(year" in plan


def test_typed_parquet_input_pushes_filters_and_prunes_columns(spark, scratch):
    from vessel_flow.operators import ingest, metrics
    from vessel_flow.sources import fixtures as fx
    fx.ais_from_events(fx.table(spark, SF, "events")).write.parquet(f"{scratch}/ais")
    typed = ingest.ingest(spark.read.parquet(f"{scratch}/ais"))
    scan = [l for l in plan_of(typed).splitlines() if "FileScan" in l][0]
    for f in ("GreaterThanOrEqual(VesselType,70)", "LessThanOrEqual(VesselType,89)"):
        assert f in scan, scan
    counts = [l for l in plan_of(metrics.vessel_counts(typed)).splitlines() if "FileScan" in l][0]
    read = re.search(r"ReadSchema: struct<([^>]*)>", counts).group(1)
    assert "LAT" not in read and "SOG" not in read, read   # only the columns the counts need


def test_split_plan_spreads_hot_vessels_over_chunks(spark):
    from vessel_flow.plans.queries import PSPLIT
    s = stages(spark, SF, PSPLIT)
    assert s.persisted                                          # the chunked rounds ran
    # each round ends in a reliable checkpoint: its plan is a scan of the saved rows
    assert all("Scan ExistingRDD" in plan_of(d) for d in s.persisted)
    # the hot rows' windows after the last checkpoint are keyed by chunk
    stops = plan_of(s.stops)
    hot_windows = [l for l in stops.splitlines() if "Window [" in l and "chunk" in l]
    assert hot_windows, stops
    # route sums of hot vessels: partial aggregate, then an exchange on the route key
    table = plan_of(s.table)
    assert "partial_sum" in table and "hashpartitioning(period" in table


def test_other_windows_use_no_percentile(spark):
    from vessel_flow.params import DEFAULT
    plan = plan_of(stages(spark, SF, DEFAULT.with_(smooth_window=7)).smoothed).lower()
    assert "percentile" not in plan and "lag(" in plan


def test_no_hot_vessel_writes_nothing(spark):
    """Without a hot vessel nothing is saved before the plan runs."""
    import os
    folder = spark.sparkContext.getCheckpointDir() or ""
    folder = folder.removeprefix("file:")
    count = lambda: sum(len(f) for _, _, f in os.walk(folder)) if folder else 0
    before = count()
    routes.routes(stages(spark, SF).table)
    assert count() == before
