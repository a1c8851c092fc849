"""Run metrics (A5, A6): counts per period as ordinary aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .routes import route_table


def vessel_counts(ingested: DataFrame) -> DataFrame:
    """Records and distinct vessels per period (A5)."""
    return (ingested.groupBy("period", "year")
            .agg(F.count(F.lit(1)).alias("records"), F.count_distinct("MMSI").alias("vessels")))


def vessel_bitmaps(ingested: DataFrame) -> DataFrame:
    """(period, bucket, vessels): the vessels of each period as exact bitmaps,
    one for each 32,768 vessel numbers.  They are small, can be kept for each
    period, and give the distinct vessels of any set of periods."""
    number = F.col("MMSI")
    return (ingested.groupBy("period", F.bitmap_bucket_number(number).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("vessels")))


def vessels_in(bitmaps: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct vessels (A5) of each range (first, last) of periods, from kept
    bitmaps alone: no position is read."""
    periods = bitmaps.select("period").distinct()  # a handful a year
    wanted = periods.join(F.broadcast(ranges), F.expr("period between first and last"))  # the caller's ranges
    merged = (bitmaps.join(wanted, "period").groupBy("first", "last", "bucket")
              .agg(F.bitmap_count(F.bitmap_or_agg("vessels")).alias("n")))
    return merged.groupBy("first", "last").agg(F.sum("n").alias("vessels"))


def run_metrics(stages) -> DataFrame:
    """Records, vessels, kept rows, stop rows, routes and flows per period.

    One pass over the tracks: the marked rows are summed per route and state
    (as the route table does) with their row counts, per vessel first."""
    base = stages.typed.groupBy("period").agg(F.count(F.lit(1)).alias("records"),
                                              F.count_distinct("MMSI").alias("vessels"))
    per_route = route_table(stages.marked.withColumn("_stop", (F.col("Label") == "1").cast("long")), counts=True)
    rest = per_route.groupBy("period").agg(
        F.sum("kept_rows").alias("kept_rows"), F.sum("stop_rows").alias("stop_rows"),
        F.count_if("is_route").alias("routes"),
        (F.sum(F.when(F.col("is_route"), F.size("transit"))) * 2).alias("flows"))
    return (base.join(rest, "period", "left")
            .select("period", "records", "vessels", "kept_rows", "stop_rows",
                    F.when(F.col("routes") > 0, F.col("routes")).alias("routes"), "flows"))


def observe_run(df: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """Attach run counters to a DataFrame that is written anyway (A6): they
    are filled by the write itself, with no extra job.  Observed metrics
    allow no DISTINCT aggregate, so the vessel count here is approximate;
    ``run_metrics`` gives the exact one.  Read ``observation.get`` after the
    action."""
    obs = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    if "MMSI" in df.columns:
        metrics.append(F.approx_count_distinct("MMSI").alias("vessels_approx"))
    if "Label" in df.columns:
        metrics.append(F.count_if(F.col("Label") == "1").alias("stop_rows"))
    return df.observe(obs, *metrics), obs
