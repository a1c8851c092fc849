"""Invariants of SURVEY section 5: flows conserve transit emissions, a month
merge equals the long union, re-running a period changes nothing."""

import math

from pyspark.sql import functions as F

from vessel_flow import sinks
from vessel_flow.operators import matrix, routes
from vessel_flow.plans.queries import PMONTH, stages

SF = "/root/testdata/sf0.001"


def test_flows_conserve_transit_emissions(spark):
    t = routes.transit_emissions(stages(spark, SF).table)
    f = routes.transfer_flows(t)
    total_t = t.agg(F.sum("emissions")).first()[0]
    total_f = f.agg(F.sum("amount")).first()[0]
    assert total_t > 0 and math.isclose(total_t, total_f, rel_tol=1e-12)
    assert math.isclose(matrix.transfer_long(f).agg(F.sum("amount")).first()[0], total_f, rel_tol=1e-12)


def test_month_merge_equals_long_union(spark):
    t = routes.transit_emissions(stages(spark, SF, PMONTH).table)
    monthly = routes.transfer_flows(t)
    merged = {(r[0], r[1], r[2]): r[3] for r in matrix.merge_periods(monthly).collect()}
    union = {}
    for r in monthly.collect():
        k = (r["year"], r["source_state"], r["dest_state"])
        union[k] = union.get(k, 0.0) + r["amount"]
    assert merged.keys() == union.keys()
    assert all(math.isclose(merged[k], union[k], rel_tol=1e-12) for k in merged)


def test_rerunning_a_period_changes_nothing(spark, scratch):
    s = stages(spark, SF)
    t = routes.transit_emissions(s.table)
    tr = matrix.transfer_long(routes.transfer_flows(t))
    for _ in range(2):
        sinks.write_routes(s.table, f"{scratch}/routes")
        sinks.write_transfers(tr, f"{scratch}/transfers")
    assert spark.read.parquet(f"{scratch}/routes").count() == s.table.count()
    assert spark.read.parquet(f"{scratch}/transfers").count() == tr.count()


def test_observed_run_counters_come_with_the_write(spark):
    from vessel_flow.operators import metrics
    s = stages(spark, SF)
    df, obs = metrics.observe_run(s.trajectory)
    df.write.format("noop").mode("overwrite").save()
    got = obs.get
    assert got["rows"] == s.trajectory.count()
    assert got["stop_rows"] == s.trajectory.filter("Label = '1'").count()
    assert abs(got["vessels_approx"] - s.trajectory.select("MMSI").distinct().count()) <= 3
