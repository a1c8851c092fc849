"""A whole run over many periods (C10 with K1, K2, K4, K7, K9, X5).

Only periods without a done marker are processed: the scan is cut to them by
literal periods (pruned where the input is partitioned by period), the
pipeline runs once with a staged copy, the outputs replace just their own
periods, and the yearly transfer sums are merged again from all stored periods
of the touched years (C9).  All tables are written as one run and switched at
once (``versions``), so readers never see new routes beside old transfers.  A
marker per period is written last, also when a period produced no row (R-Q12).
A failed run leaves the old rows and no marker; the next run redoes exactly
the unfinished periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, versions
from ..operators import ingest, matrix
from ..params import DEFAULT, Params
from ..session import checkpoint_dir
from .pipeline import emission_pipeline


def input_periods(ais: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The periods of the input, from its ``period`` column if it has one."""
    if "period" in ais.columns:
        return ais.select(F.col("period").cast("int")).distinct()
    return ingest.keyed(ingest.typed_ais(ais, p), p).select("period").distinct()


def run_emission_job(spark: SparkSession, ais: DataFrame, ports: DataFrame, state_rings: DataFrame,
                     out_dir: str, p: Params = DEFAULT, years: list[int] | None = None) -> list[int]:
    """Process the pending periods of ``ais`` (of ``years``, if given) into
    ``out_dir``; returns them.

    Layout: ``trajectory/`` (the 11 columns, keys and ``seq`` of accepted
    vessels), ``rejects/``, ``routes/``, ``flows/``, ``period_sums/``,
    ``transfers/``, ``vessels/`` (bitmaps of each period's vessels; Parquet,
    partitioned by year / period), to be read by ``sinks.stored``, ``done/``
    (markers), and ``stage/``, the run's working copy, removed at its end."""
    checkpoint_dir(spark)  # a missing setting shows at the start, not in the middle of a run
    out = out_dir.rstrip("/")
    year_of = (lambda t: t // 100) if p.period == "month" else (lambda t: t)
    # one row per period: a handful per year of data
    todo = sorted(r["period"] for r in sinks.pending_periods(spark, input_periods(ais, p), f"{out}/done").collect()
                  if years is None or year_of(r["period"]) in years)
    if not todo:
        return []
    store = versions.Store(spark, out)
    run = store.begin()
    stage = f"{out}/stage/{run.name}"
    res = emission_pipeline(spark, ais, ports, state_rings, p, stage_dir=stage, periods=todo)
    sinks.write_trajectory(res["trajectory"], (run, "trajectory"), todo)
    sinks.write_rejects(res["rejects"], (run, "rejects"), todo)
    sinks.write_routes(res["route_table"], (run, "routes"), todo)
    sinks.write_flows(res["flows"], (run, "flows"), todo)
    res["route_table"].unpersist()
    # transfers are sums per year: the kept sums of all periods of the touched
    # years (C9), with this run's in place of older ones; no flow is read again
    touched = sorted({year_of(t) for t in todo})
    sinks.write_period_sums(matrix.period_sums(run.read("flows", sinks.FLOW_SCHEMA)), (run, "period_sums"), todo)
    sums = run.read("period_sums", sinks.FLOW_SCHEMA)
    before = store.read("period_sums", sinks.FLOW_SCHEMA, run.base["number"]) if run.base["number"] else None
    if before is not None:
        sums = sums.unionByName(before.where(F.col("year").isin(touched) & ~F.col("period").isin(todo)))
    sinks.write_transfers(matrix.transfer_long(sums), (run, "transfers"), touched)
    sinks.write_vessel_bitmaps(res["vessels"], (run, "vessels"), todo)
    run.commit()
    sinks.mark_done(spark, todo, f"{out}/done")
    store.files.delete("stage", run.name)
    store.vacuum()
    return todo
