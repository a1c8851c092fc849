"""Track smoothing and stop collapsing (C1, C2) as window scans.

All windows are partitioned by (period, MMSI), so the single hash exchange
ahead of them is reused.  The work is done in two sorted passes:

* ascending (raw time order): row number, rolling median, slow flag, run
  ids, run duration (known at a run's last row) and the merge decision
  (known there too: gap to the previous qualified run's end);
* descending (the same order reversed): facts that look forward - is a row
  inside a stop, is a qualified run the last of its stop - become running
  ``last(..., ignorenulls)`` values, so no quadratic "unbounded following"
  frame is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.emission import is_slow
from ..params import DEFAULT, Params
from .ingest import KEY

# Sort key of a track: raw values, kept beside the smoothed ones so that every
# ascending window shares one sort; the extra keys make the order total.
ORDER = ["BaseDateTime", "raw_LAT", "raw_LON", "raw_SOG", "VesselType"]
MICROS_PER_HOUR = 3_600_000_000


def w_raw(key=KEY):
    """Raw time order (see ORDER)."""
    return Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])


def w_asc(key=KEY):
    return Window.partitionBy(*key).orderBy(F.col("seq").asc())


def w_desc(key=KEY):
    return Window.partitionBy(*key).orderBy(F.col("seq").desc())


def w_vessel(key=KEY):
    return Window.partitionBy(*key)


RUNNING = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def micros_between(a: Column, b: Column) -> Column:
    """b - a in microseconds, time-zone free (works on TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", a, b)


def _median3_sql(prev: str, cur: str, nxt: str) -> str:
    """Median of the non-null values among three (pandas rolling median,
    min_periods=1): 3 values -> middle, 2 -> mean, 1 -> itself."""
    n = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN 1 ELSE 0 END" for v in (prev, cur, nxt))
    mid3 = f"greatest(least({prev}, {cur}), least(greatest({prev}, {cur}), {nxt}))"
    total = f"coalesce({prev}, 0D) + coalesce({cur}, 0D) + coalesce({nxt}, 0D)"
    return (f"CASE WHEN ({n}) = 3 THEN {mid3} WHEN ({n}) = 2 THEN ({total}) / 2 "
            f"WHEN ({n}) = 1 THEN coalesce({prev}, {cur}, {nxt}) END")


def rolling_median(c: str, window: int, key=KEY, order=ORDER) -> Column:
    """Centred rolling median over ``window`` rows of a track in ``order``."""
    spec = f"PARTITION BY {', '.join(key)} ORDER BY " + ", ".join(f"{o} ASC NULLS LAST" for o in order)
    if window == 3:
        return F.expr(_median3_sql(f"lag({c}, 1) OVER ({spec})", c, f"lead({c}, 1) OVER ({spec})"))
    # the rows around, sorted: no frame is evaluated for each row
    near = [f"lag({c}, {-k}) OVER ({spec})" if k < 0 else f"lead({c}, {k}) OVER ({spec})" if k else c
            for k in range(-(window // 2), window - window // 2)]
    run = f"array_sort(filter(array({', '.join(near)}), v -> v IS NOT NULL))"
    return F.expr(f"get(transform(array({run}), s -> (get(s, (size(s) - 1) div 2) + get(s, size(s) div 2)) / 2), 0)")


def smooth_tracks(df: DataFrame, p: Params = DEFAULT, key=KEY) -> DataFrame:
    """Number rows in time order and smooth LAT/LON/SOG with a centred rolling
    median for vessels with more than 3 rows (C1: A12, W1, U2).

    Adds ``seq`` (1-based, fixed on raw rows), ``n_rows`` and
    ``first_type`` (VesselType of the first row, A11)."""
    df = df.withColumnsRenamed({c: f"raw_{c}" for c in ("LAT", "LON", "SOG")})
    w = w_raw(key)
    out = df.select(
        "*",
        F.row_number().over(w).alias("seq"),
        F.count(F.lit(1)).over(w_vessel(key)).alias("n_rows"),
        F.first("VesselType").over(w.rowsBetween(*RUNNING)).alias("first_type"),
        *[rolling_median(f"raw_{c}", p.smooth_window, key).alias(f"_m_{c}") for c in ("LAT", "LON", "SOG")],
    )
    gate = F.col("n_rows") >= p.smooth_min_rows
    for c in ("LAT", "LON", "SOG"):
        out = out.withColumn(c, F.when(gate, F.col(f"_m_{c}")).otherwise(F.col(f"raw_{c}"))).drop(f"_m_{c}")
    return out


def mark_runs(df: DataFrame, p: Params = DEFAULT, key=KEY) -> DataFrame:
    """Slow runs and merge decisions on smoothed rows, ascending pass
    (W2, A7, W3).  Adds:

    * ``slow``; ``run_first`` / ``run_last`` (first / last row of a slow run);
    * ``run_start_seq``, ``run_start_ts`` (of the slow run a row is in);
    * ``run_micros`` and ``qualified`` (at a run's last row: duration >= min);
    * ``new_stop`` (at a qualified run's last row: no earlier qualified run,
      or the gap from its end is >= the merge gap).
    """
    # same order as the smoothing window: no second sort
    w = w_raw(key)
    df = df.withColumn("slow", is_slow(F.col("SOG"), p))
    df = df.select("*",
                   F.coalesce(F.lag("slow", 1).over(w), F.lit(False)).alias("_prev_slow"),
                   F.coalesce(F.lead("slow", 1).over(w), F.lit(False)).alias("_next_slow"))
    df = (df.withColumn("run_first", F.col("slow") & ~F.col("_prev_slow"))
            .withColumn("run_last", F.col("slow") & ~F.col("_next_slow"))
            .drop("_prev_slow", "_next_slow"))
    return mark_qualified(df, p, w)


def mark_qualified(df: DataFrame, p: Params, w) -> DataFrame:
    """Run start, duration, qualification and merge decision from the run
    marks, by running frames of the ascending window ``w``."""
    df = df.select(
        "*",
        F.when(F.col("slow"), F.last(F.when(F.col("run_first"), F.col("seq")), True)
               .over(w.rowsBetween(*RUNNING))).alias("run_start_seq"),
        F.when(F.col("slow"), F.last(F.when(F.col("run_first"), F.col("BaseDateTime")), True)
               .over(w.rowsBetween(*RUNNING))).alias("run_start_ts"),
    )
    min_us = int(round(p.min_stop_hours * MICROS_PER_HOUR))
    gap_us = int(round(p.merge_gap_hours * MICROS_PER_HOUR))
    df = (df.withColumn("run_micros", F.when(F.col("run_last"),
                                             micros_between(F.col("run_start_ts"), F.col("BaseDateTime"))))
            .withColumn("qualified", F.coalesce(F.col("run_micros") >= F.lit(min_us), F.lit(False))))
    prev_end = F.last(F.when(F.col("qualified"), F.col("BaseDateTime")), True).over(w.rowsBetween(*BEFORE))
    return df.withColumn(
        "new_stop",
        F.col("qualified") & (prev_end.isNull()
                              | (micros_between(prev_end, F.col("run_start_ts")) >= F.lit(gap_us))))


def mark_stops(df: DataFrame, key=KEY) -> DataFrame:
    """Descending pass: stop membership and end points.

    For each row, the nearest qualified run whose last row is at or after it
    decides: the row is inside that run, or in the gap before it, and that
    gap is inside a stop iff the run merges into the previous one.  Adds
    ``in_stop``, ``stop_start``, ``stop_end``, ``keep`` and ``Label``."""
    w = w_desc(key)
    q_start = F.last(F.when(F.col("qualified"), F.col("run_start_seq")), True).over(w.rowsBetween(*RUNNING))
    q_new = F.last(F.when(F.col("qualified"), F.col("new_stop")), True).over(w.rowsBetween(*RUNNING))
    q_new_after = F.last(F.when(F.col("qualified"), F.col("new_stop")), True).over(w.rowsBetween(*BEFORE))
    df = df.select("*", q_start.alias("_q_start"), q_new.alias("_q_new"), q_new_after.alias("_q_new_after"))
    return stop_flags(df)


def stop_flags(df: DataFrame) -> DataFrame:
    """Stop membership from the nearest following qualified run
    (``_q_start``, ``_q_new``, ``_q_new_after``)."""
    in_run = F.coalesce(F.col("_q_start") <= F.col("seq"), F.lit(False))
    in_gap = F.coalesce((F.col("_q_start") > F.col("seq")) & ~F.col("_q_new"), F.lit(False))
    stop_start = in_run & F.col("_q_new") & (F.col("seq") == F.col("_q_start"))
    stop_end = F.col("qualified") & F.coalesce(F.col("_q_new_after"), F.lit(True))
    df = (df.withColumn("in_stop", in_run | in_gap)
            .withColumn("stop_start", F.coalesce(stop_start, F.lit(False)))
            .withColumn("stop_end", stop_end)
            .drop("_q_start", "_q_new", "_q_new_after"))
    return (df.withColumn("keep", ~F.col("in_stop") | F.col("stop_start") | F.col("stop_end"))
              .withColumn("Label", F.when(F.col("stop_start") | F.col("stop_end"), F.lit("1"))
                          .otherwise(F.lit("0"))))


def collapse_stops(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Smoothed rows -> rows with Label, stop interiors dropped (C2, P15, R-Q1)."""
    return mark_stops(mark_runs(df, p)).filter(F.col("keep"))


def slow_runs(marked: DataFrame) -> DataFrame:
    """One row per slow run, from the output of ``mark_runs``."""
    return (marked.filter(F.col("run_last"))
            .select(*KEY, F.col("run_start_ts").alias("start_time"),
                    F.col("BaseDateTime").alias("end_time"),
                    (F.col("seq") - F.col("run_start_seq") + 1).alias("n_rows"),
                    (F.col("run_micros") / F.lit(float(MICROS_PER_HOUR))).alias("hours"),
                    F.col("qualified")))


def merged_stops(marked_runs: DataFrame) -> DataFrame:
    """One row per merged stop (W3): start / end time and the number of slow
    runs it absorbed, from the output of ``mark_runs``.

    Only qualified runs take part (one row each, at the run's last row).  They
    are disjoint and each lasts at least ``min_stop_hours``, so a vessel-year
    has at most 8,784 / min_stop_hours + 1 of them: the window below has a
    bounded group even for a hot vessel.  The stop number is a running count
    of ``new_stop``."""
    q = marked_runs.filter(F.col("qualified")).select(*KEY, "seq", "run_start_ts", "BaseDateTime", "new_stop")
    w = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(*RUNNING)
    q = q.withColumn("_stop", F.sum(F.col("new_stop").cast("int")).over(w))
    return (q.groupBy(*KEY, "_stop")
            .agg(F.min("run_start_ts").alias("start_time"), F.max("BaseDateTime").alias("end_time"),
                 F.count(F.lit(1)).alias("n_runs"))
            .drop("_stop"))
