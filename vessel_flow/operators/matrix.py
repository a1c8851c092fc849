"""Transfer sums, pivoted matrix, wide routes, period merge.

Pivots run on aggregated data (one row per state pair or per route), never
on track rows; their column list is the distinct destination / transit
states, which is bounded by the polygon map (a caller that has the map names them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .routes import ROUTE_KEY


def transfer_long(flows: DataFrame) -> DataFrame:
    """Sum flows per (year, source, dest) (A1); partial + final aggregate."""
    return flows.groupBy("year", "source_state", "dest_state").agg(F.sum("amount").alias("amount"))


def transfer_matrix(transfers: DataFrame, dests: list[str] | None = None) -> DataFrame:
    """(year, source_state) x destination states, gaps 0.

    ``dests`` fixes the columns; by default they are the destinations seen."""
    if dests is None:
        transfers = cut_lineage(transfers)  # one row per state pair, read again for the columns
        dests = distinct_values(transfers, "dest_state")
    fixed = ["year", "source_state"]
    if not dests:
        return transfers.select(*fixed).distinct()
    wide = transfers.groupBy(*fixed).pivot("dest_state", dests).agg(F.sum("amount"))
    return wide.na.fill(0.0, subset=list(dests)).select(*fixed, *sorted(dests))


def distinct_values(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct non-null values of a state column.  The list is bounded
    by the polygon map (one name per state), not by the data."""
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())


WIDE_FIXED = ["year", "MMSI", "start_port", "start_state", "end_port", "end_state", "total_emissions"]


def wide_routes(table: DataFrame, states: list[str] | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """Routes with one column per transit state, sorted, gaps 0.

    Built from ``route_table``: transit entries are exploded (outer, so routes
    without transit survive) and pivoted back per route; the grouping keys
    include (period, MMSI), so no exchange is added."""
    keep = keep or WIDE_FIXED
    base = table.select(*ROUTE_KEY, *[c for c in keep if c not in ROUTE_KEY],
                        F.explode_outer("transit").alias("_t"))
    base = base.select("*", F.col("_t.state").alias("_state"), F.col("_t.emissions").alias("_em")).drop("_t")
    if states is None:
        base = cut_lineage(base)  # one row per (route, transit state), read again for the columns
        states = distinct_values(base, "_state")
    group = [*ROUTE_KEY, *[c for c in keep if c not in ROUTE_KEY]]
    if not states:
        return table.select(*keep)
    piv = base.groupBy(*group).pivot("_state", states).agg(F.sum("_em"))
    return piv.na.fill(0.0, subset=list(states)).select(*keep, *sorted(states))


def merge_periods(monthly_flows: DataFrame) -> DataFrame:
    """Raw monthly flows of a year -> yearly transfer sums (C9: S10, U3, A1).

    Flows stay long, so months with different state sets union by name."""
    return transfer_long(monthly_flows)


def period_sums(flows: DataFrame) -> DataFrame:
    """Partial sums of flows by period and state pair, to be kept (C9).  A
    year's sums are those of its periods, so a period that is done again costs
    its own flows and a few rows of the others."""
    return flows.groupBy("year", "period", "source_state", "dest_state").agg(F.sum("amount").alias("amount"))


def union_wide(tables: list[DataFrame]) -> DataFrame:
    """Union wide tables whose state columns differ; gaps 0."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    known = {*WIDE_FIXED, *ROUTE_KEY, "start_time", "end_time", "source_state"}
    states = sorted(c for c in out.columns if c not in known)
    return out.select(*[c for c in out.columns if c in known], *states).na.fill(0.0, subset=states)
