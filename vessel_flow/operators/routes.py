"""Stays, routes, transit emissions and transfer flows.

A *stay* starts on an at-port row (Label '1' with a port) whose previous
kept row is not at port (W9, R-Q4).  Route k runs from stay start k to stay
start k+1, both included (R-Q3).  In the descending pass every row gets
``route_key`` = number of stay starts strictly after it: rows of route k
(from start k up to, not including, start k+1) share one key, so a
``groupBy(period, MMSI, route_key)`` - which reuses the vessel partitioning -
sums a route; the next start's CO2, port and state are carried onto start k
by a running ``last(..., ignorenulls)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import KEY
from .tracks import BEFORE, w_desc

ROUTE_KEY = [*KEY, "route_key"]


def at_port():
    """An at-port row: a stop end point matched to a port (F8)."""
    return (F.col("Label") == "1") & F.col("PortName").isNotNull()


def mark_stays(traj: DataFrame, key=KEY) -> DataFrame:
    """Adds ``at_port``, ``stay_start``, ``route_key`` and, on stay starts,
    ``next_time``, ``next_port``, ``next_state``, ``next_co2`` of the next
    stay start (W9, W10, F8)."""
    w = w_desc(key)
    df = traj.withColumn("at_port", at_port())
    df = df.withColumn("stay_start", F.col("at_port")
                       & ~F.coalesce(F.lead("at_port", 1).over(w), F.lit(False)))
    after = w.rowsBetween(*BEFORE)

    def nxt(c):
        return F.last(F.when(F.col("stay_start"), F.col(c)), True).over(after)

    return df.select(
        "*",
        F.coalesce(F.sum(F.col("stay_start").cast("int")).over(after), F.lit(0)).alias("route_key"),
        nxt("BaseDateTime").alias("next_time"), nxt("PortName").alias("next_port"),
        nxt("State").alias("next_state"), nxt("CO2").alias("next_co2"),
    )


def stays(marked: DataFrame) -> DataFrame:
    """One row per stay start."""
    return (marked.filter(F.col("stay_start"))
            .select(*KEY, "year", F.col("BaseDateTime").alias("start_time"),
                    F.col("PortName").alias("port"), F.col("State").alias("state")))


def stay_pairs(marked: DataFrame) -> DataFrame:
    """Each stay paired with the next one; the last stay has none."""
    return (marked.filter(F.col("stay_start") & F.col("next_time").isNotNull())
            .select(*KEY, "year", F.col("BaseDateTime").alias("start_time"),
                    F.col("next_time").alias("end_time"),
                    F.col("PortName").alias("start_port"), F.col("State").alias("start_state"),
                    F.col("next_port").alias("end_port"), F.col("next_state").alias("end_state")))


def route_table(marked: DataFrame, key=KEY, counts: bool = False) -> DataFrame:
    """One row per route (C5, A2, A3, A4, P11) from a two-level aggregation
    that keeps the vessel partitioning (no exchange, no self-join):

    1. per (route, State): CO2 sum, first row, whether the stay start is in it;
    2. per route: total CO2 (+ the next start row's CO2, R-Q3), start / end
       port and state, and ``transit`` = array of (first_seq, state,
       emissions) for states other than start and end with a positive sum,
       in first-seen order (P12, R-Q6); ``states_seen`` = all states.

    Routes with a null start or end state are skipped, as in the reference.
    With ``counts`` every group of rows stays, with ``kept_rows``,
    ``stop_rows`` (from a column ``_stop``) and ``is_route``."""
    start_info = F.struct(F.col("BaseDateTime").alias("start_time"), F.col("next_time").alias("end_time"),
                          F.col("PortName").alias("start_port"), F.col("next_port").alias("end_port"),
                          F.col("next_state").alias("end_state"), F.col("next_co2").alias("next_co2"))
    # collect_list keeps both levels hash-based (max over a struct or a
    # string would fall back to a sort-based aggregate); each list holds at
    # most one element, the route's start row.
    rk = [*key, "route_key"]
    lvl1 = (marked.groupBy(*rk, "State")
            .agg(F.max("year").alias("year"), F.sum("CO2").alias("co2"), F.min("seq").alias("first_seq"),
                 F.bool_or("stay_start").alias("has_start"),
                 F.collect_list(F.when(F.col("stay_start"), start_info)).alias("info"),
                 *([F.count(F.lit(1)).alias("_n"), F.sum("_stop").alias("_s")] if counts else [])))
    lvl2 = (lvl1.groupBy(*rk)
            .agg(F.max("year").alias("year"), F.sum("co2").alias("co2"),
                 F.try_element_at(F.flatten(F.collect_list("info")), F.lit(1)).alias("info"),
                 F.try_element_at(F.collect_list(F.when(F.col("has_start"), F.col("State"))), F.lit(1))
                 .alias("start_state"),
                 F.collect_list(F.when(F.col("State").isNotNull(),
                                       F.struct("first_seq", F.col("State").alias("state"),
                                                F.col("co2").alias("emissions")))).alias("_per_state"),
                 *([F.sum("_n").alias("kept_rows"), F.sum("_s").alias("stop_rows")] if counts else [])))
    whole = (F.col("info").isNotNull() & F.col("info.end_time").isNotNull()
             & F.col("start_state").isNotNull() & F.col("info.end_state").isNotNull())
    extra = ["kept_rows", "stop_rows", whole.alias("is_route")] if counts else []
    r = ((lvl2 if counts else lvl2.filter(whole))
         .select(*rk, "year", "info.start_time", "info.end_time", "info.start_port", "start_state",
                 "info.end_port", "info.end_state",
                 (F.col("co2") + F.col("info.next_co2")).alias("total_emissions"), "_per_state", *extra))
    transit = F.array_sort(F.filter(F.col("_per_state"), lambda e: (e.state != F.col("start_state"))
                                    & (e.state != F.col("end_state")) & (e.emissions > 0)))
    seen = F.array_sort(F.array_union(F.transform(F.col("_per_state"), lambda e: e.state),
                                      F.array(F.col("end_state"))))
    return r.withColumn("transit", transit).withColumn("states_seen", seen).drop("_per_state")


ROUTE_COLUMNS = [*ROUTE_KEY, "year", "start_time", "end_time", "start_port", "start_state",
                 "end_port", "end_state", "total_emissions"]


def routes(table: DataFrame) -> DataFrame:
    return table.select(*ROUTE_COLUMNS)


def route_state_lists(table: DataFrame) -> DataFrame:
    """Distinct states seen on a route, both end rows included (A4)."""
    return table.select(*ROUTE_KEY, "year", "start_time", F.array_join("states_seen", ",").alias("states"))


def transit_emissions(table: DataFrame) -> DataFrame:
    """One row per (route, transit state)."""
    return (table.select(*ROUTE_KEY, "year", "start_time", "start_state", "end_state",
                         F.explode("transit").alias("_t"))
            .select(*ROUTE_KEY, "year", "start_time", "start_state", "end_state",
                    "_t.first_seq", "_t.state", "_t.emissions"))


def routes_with_state_map(table: DataFrame) -> DataFrame:
    """Routes plus ``state_emissions`` map (null when none), first-seen order,
    and its JSON text for sinks (A10, F13): the same keys, numbers and order
    as the reference's text, without its blanks after separators."""
    entries = F.transform(F.col("transit"), lambda e: F.struct(e.state.alias("key"),
                                                               e.emissions.alias("value")))
    m = F.when(F.size("transit") > 0, F.map_from_entries(entries))
    return table.select(*ROUTE_COLUMNS, m.alias("state_emissions"), F.to_json(m).alias("state_emissions_json"))


def transfer_flows(transit: DataFrame) -> DataFrame:
    """Each transit amount split in halves: (start, transit) and (end,
    transit); equal start and end states get both halves (F9, R-Q5)."""
    half = F.col("emissions") / 2.0
    pair = F.explode(F.array(
        F.struct(F.col("start_state").alias("source_state"), half.alias("amount")),
        F.struct(F.col("end_state").alias("source_state"), half.alias("amount"))))
    return (transit.select(*ROUTE_KEY, "year", "start_time", F.col("state").alias("dest_state"),
                           pair.alias("_f"))
            .select(*ROUTE_KEY, "year", "start_time", "_f.source_state", "dest_state", "_f.amount"))
