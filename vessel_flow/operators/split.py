"""Hot-vessel splitting: exact window scans over row chunks.

All track windows are partitioned by (period, MMSI), so one vessel-period
is one task.  A key that holds a large share of all rows (a default MMSI
used by many transponders, say) would then run on a single executor.  Such
vessels are split into chunks of ``chunk_rows`` rows, and the same scans run
per chunk in parallel.  Whatever a scan needs from beyond its chunk is a
*carry*: each round aggregates a small summary per chunk (no exchange: the
rows are partitioned by chunk), resolves the carries with a window over the
chunks of a vessel, and joins them back.

Rounds (each ends with a reliable checkpoint in ``spark.checkpoint.dir``, so
that the summary and the next round read it once, the plan stays small and
a lost executor costs only the current round; a round runs when a stage that
needs it is first asked for):

0. row numbers: hot rows are range-partitioned in track order, so bursts are
   cut by rows and not by time; a running sum of the slices' counts gives
   every row its global ``seq``, and ``chunk`` = (seq - 1) / chunk_rows
   (small chunks share a slice, see ``slice_count``);
1. halo: rows near a chunk's edge are copied to the chunks beside it
   (smoothing and slow flags, for any smoothing window);
2. start of a slow run that is open when the chunk begins, and end of the
   last qualified run before the chunk (merge decision);
3. nearest qualified run at or after the chunk end (stop membership);
4. neighbouring kept rows (time difference, next point) and the reject flag;
5. stays: the previous kept row's at-port flag, stay starts and the next
   stay start after the chunk (route keys).

Routes of hot vessels are then summed with a partial aggregate per chunk
and one small exchange on the route key.

Bounds: there are at most rows / ``hot_vessel_rows`` hot vessel-periods and
rows / ``chunk_rows`` + that many chunks.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.emission import is_slow
from ..params import DEFAULT, Params
from ..session import cut_lineage
from .emissions import bad_stop_row, co2_columns
from .ingest import partition_by_vessel
from .routes import at_port
from .tracks import BEFORE, RUNNING, rolling_median, stop_flags, w_asc, w_desc

VKEY = ["period", "MMSI"]
CKEY = ["period", "MMSI", "chunk"]
RAW_ORDER = ["BaseDateTime", "LAT", "LON", "SOG", "VesselType"]


def vessel_stats(ing: DataFrame) -> DataFrame:
    """Rows per vessel-period (partial + final aggregate)."""
    return ing.groupBy(*VKEY).agg(F.count(F.lit(1)).alias("n"))


def hot_vessels(stats: DataFrame, p: Params = DEFAULT) -> DataFrame | None:
    """(period, MMSI, n_total) of every hot vessel-period, or None without any.
    One aggregate tells that there is none; only a set with rows is saved."""
    hot = stats.filter(F.col("n") > p.hot_vessel_rows).withColumnRenamed("n", "n_total")
    return None if hot.isEmpty() else cut_lineage(hot)


def mark_hot(ing: DataFrame, hot: DataFrame) -> DataFrame:
    """``hot`` and ``n_total``.  The broadcast side has one row for each
    vessel-period above ``hot_vessel_rows`` rows: at most rows / that many."""
    return ing.join(F.broadcast(hot), VKEY, "left").withColumn("hot", F.col("n_total").isNotNull())


def _chunk_windows():
    asc = Window.partitionBy(*VKEY).orderBy("chunk")
    desc = Window.partitionBy(*VKEY).orderBy(F.col("chunk").desc())
    return asc, desc


def _keep(df: DataFrame, bag: list) -> DataFrame:
    """End of a round: checkpoint into the shared folder.  A summary and the
    next round both read the result, and each round's plan would otherwise
    contain the previous one twice."""
    df = cut_lineage(df)
    bag.append(df)
    return df


def _carry(df: DataFrame, summary: DataFrame) -> DataFrame:
    """One summary row a chunk.  Both sides are partitioned by chunk, so the
    join moves no rows; Spark broadcasts the summaries where they are small."""
    return df.join(summary, CKEY, "left")


def slice_count(n: int, partitions: int, p: Params) -> int:
    """Slices of ``n`` hot rows: one for each chunk's worth of rows, but beyond
    the session's partitions none below ``slice_rows`` rows.  A slice is a task
    and sends a sample and its bounds to the driver, a chunk is only a key."""
    return min(math.ceil(n / p.chunk_rows), max(partitions, math.ceil(n / p.slice_rows)))


def numbered(rows: DataFrame, hot: DataFrame, p: Params, bag: list) -> DataFrame:
    """Round 0: ``seq`` in track order and the row's ``chunk``."""
    slices = slice_count(hot.agg(F.sum("n_total")).first()[0], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), p)
    order = [F.col(c).asc_nulls_last() for c in RAW_ORDER]
    # the range bounds are sampled anew for each plan, so the slices are fixed by a checkpoint
    h = _keep(rows.repartitionByRange(slices, *VKEY, *order).withColumn("slice", F.spark_partition_id()), bag)
    count = h.groupBy(*VKEY, "slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*VKEY).orderBy("slice").rowsBetween(*BEFORE)
    offset = count.select(*VKEY, "slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*VKEY, "slice").orderBy(*order))
    # as many summaries as slices and hot vessels
    h = h.withColumn("_place", place).join(F.broadcast(offset), [*VKEY, "slice"])
    h = h.withColumn("seq", (F.col("_offset") + F.col("_place")).cast("int")).drop("slice", "_place", "_offset")
    return _keep(h.withColumn("chunk", chunk_of(F.col("seq"), p)), bag)


def chunk_of(seq: Column, p: Params) -> Column:
    return F.floor((seq - 1) / p.chunk_rows).cast("int")


class HotStages:
    """The stages of hot rows, each round run when it is first asked for.
    ``persisted`` holds the rounds' checkpoints."""

    def __init__(self, hot_rows: DataFrame, hot: DataFrame, p: Params = DEFAULT):
        self.p, self.persisted = p, []
        self.ingested = numbered(hot_rows, hot, p, self.persisted)

    @cached_property
    def smoothed(self) -> DataFrame:
        """Round 1: rows within ``halo`` rows of a chunk are copied into it;
        the windows of its own rows are then whole."""
        p = self.p
        halo = p.smooth_window // 2 + 1
        of = lambda seq: chunk_of(seq, p)
        first = self.ingested.where("seq = 1").select(*VKEY, F.col("VesselType").alias("first_type"))
        near = F.sequence(F.greatest(of(F.col("seq") - halo), F.lit(0)),
                          of(F.least(F.col("seq") + halo, F.col("n_total"))))
        h = (self.ingested.withColumnsRenamed({c: f"raw_{c}" for c in ("LAT", "LON", "SOG")})
             .withColumnRenamed("chunk", "_own").withColumn("chunk", F.explode(near)))
        h = partition_by_vessel(h, CKEY, n=p.track_partitions)
        w, gate = w_asc(CKEY), F.col("n_total") >= p.smooth_min_rows
        h = h.select("*", *[F.when(gate, rolling_median(f"raw_{c}", p.smooth_window, CKEY, ["seq"]))
                            .otherwise(F.col(f"raw_{c}")).alias(c) for c in ("LAT", "LON", "SOG")])
        h = h.withColumn("slow", is_slow(F.col("SOG"), p))
        h = h.select("*", F.coalesce(F.lag("slow", 1).over(w), F.lit(False)).alias("_prev_slow"),
                     F.coalesce(F.lead("slow", 1).over(w), F.lit(False)).alias("_next_slow"))
        h = h.where("chunk = _own").join(F.broadcast(first), VKEY)  # one row for each hot vessel-period
        h = (h.withColumn("run_first", F.col("slow") & ~F.col("_prev_slow"))
              .withColumn("run_last", F.col("slow") & ~F.col("_next_slow"))
              .withColumnRenamed("n_total", "n_rows").drop("_own", "_prev_slow", "_next_slow"))
        return _keep(h, self.persisted)

    @cached_property
    def runs(self) -> DataFrame:
        h, p, w = self.smoothed, self.p, w_asc(CKEY)
        ca, _ = _chunk_windows()
        # --- round 2: open run at the chunk start and last qualified end before it --
        # A run that starts in the chunk is measured locally.  The chunk's leading
        # run (open when the chunk begins) needs the start carried in; whether it
        # qualifies is resolved on the chunk table together with that carry.
        min_us = int(round(p.min_stop_hours * 3_600_000_000))
        gap_us = int(round(p.merge_gap_hours * 3_600_000_000))
        running = w.rowsBetween(*RUNNING)
        h = h.select("*",
                     F.last(F.when(F.col("run_first"), F.col("seq")), True).over(running).alias("_ls"),
                     F.last(F.when(F.col("run_first"), F.col("BaseDateTime")), True).over(running).alias("_lt"))
        local_q = F.col("run_last") & F.col("_lt").isNotNull() & (
            F.timestamp_diff("MICROSECOND", F.col("_lt"), F.col("BaseDateTime")) >= F.lit(min_us))
        s2 = (h.groupBy(*CKEY)
              .agg(F.max(F.when(F.col("run_first"), F.col("seq"))).alias("rf_seq"),
                   F.max(F.when(F.col("run_first"), F.col("BaseDateTime"))).alias("rf_ts"),
                   F.min(F.when(F.col("run_last") & F.col("_lt").isNull(), F.col("BaseDateTime"))).alias("lead_end"),
                   F.max(F.when(local_q, F.col("BaseDateTime"))).alias("local_qe"))
              .select("*", F.last("rf_seq", True).over(ca.rowsBetween(*BEFORE)).alias("_c_seq"),
                      F.last("rf_ts", True).over(ca.rowsBetween(*BEFORE)).alias("_c_ts")))
        lead_q = F.col("lead_end").isNotNull() & F.col("_c_ts").isNotNull() & (
            F.timestamp_diff("MICROSECOND", F.col("_c_ts"), F.col("lead_end")) >= F.lit(min_us))
        s2 = s2.withColumn("chunk_qe", F.coalesce(F.col("local_qe"), F.when(lead_q, F.col("lead_end"))))
        s2 = s2.select(*CKEY, "_c_seq", "_c_ts",
                       F.last("chunk_qe", True).over(ca.rowsBetween(*BEFORE)).alias("_c_qe"))
        h = _carry(h, s2)
        h = (h.withColumn("run_start_seq", F.when(F.col("slow"), F.coalesce("_ls", "_c_seq")))
              .withColumn("run_start_ts", F.when(F.col("slow"), F.coalesce("_lt", "_c_ts")))
              .drop("_ls", "_lt", "_c_seq", "_c_ts"))
        h = (h.withColumn("run_micros", F.when(F.col("run_last"), F.timestamp_diff(
                "MICROSECOND", F.col("run_start_ts"), F.col("BaseDateTime"))))
              .withColumn("qualified", F.coalesce(F.col("run_micros") >= F.lit(min_us), F.lit(False))))
        prev_end = F.coalesce(F.last(F.when(F.col("qualified"), F.col("BaseDateTime")), True)
                              .over(w.rowsBetween(*BEFORE)), F.col("_c_qe"))
        h = h.withColumn("new_stop", F.col("qualified") & (prev_end.isNull() | (
            F.timestamp_diff("MICROSECOND", prev_end, F.col("run_start_ts")) >= F.lit(gap_us)))).drop("_c_qe")
        return _keep(h, self.persisted)

    @cached_property
    def stops(self) -> DataFrame:
        h, wd = self.runs, w_desc(CKEY)
        _, cd = _chunk_windows()
        # --- round 3: nearest qualified run at or after the chunk end ----------------
        # every chunk needs a carry, also those without a qualified run
        chunks = h.groupBy(*CKEY).agg(F.count(F.lit(1)).alias("_n"))
        fq = (h.filter("qualified").groupBy(*CKEY)
              .agg(F.min_by(F.struct("run_start_seq", "new_stop"), "seq").alias("fq")))
        s3 = (chunks.join(fq, CKEY, "left")
              .select(*CKEY, F.last("fq", True).over(cd.rowsBetween(*BEFORE)).alias("_c_fq")))
        h = _carry(h, s3)
        h = h.select("*",
                     F.coalesce(F.last(F.when(F.col("qualified"), F.col("run_start_seq")), True)
                                .over(wd.rowsBetween(*RUNNING)), F.col("_c_fq.run_start_seq")).alias("_q_start"),
                     F.coalesce(F.last(F.when(F.col("qualified"), F.col("new_stop")), True)
                                .over(wd.rowsBetween(*RUNNING)), F.col("_c_fq.new_stop")).alias("_q_new"),
                     F.coalesce(F.last(F.when(F.col("qualified"), F.col("new_stop")), True)
                                .over(wd.rowsBetween(*BEFORE)), F.col("_c_fq.new_stop")).alias("_q_new_after"))
        return stop_flags(h.drop("_c_fq"))

    @cached_property
    def co2(self) -> DataFrame:
        wd = w_desc(CKEY)
        ca, cd = _chunk_windows()
        # --- round 4: neighbouring kept rows, reject flag ----------------------------
        k = self.stops.filter(F.col("keep"))
        k = k.select("*", F.lead("seq", 1).over(wd).alias("_pseq"), F.lead("BaseDateTime", 1).over(wd).alias("_pt"),
                     F.lag("seq", 1).over(wd).alias("_nseq"),
                     *[F.lag(c, 1).over(wd).alias(f"_n_{c}") for c in ("LAT", "LON", "SOG")])
        k = _keep(k, self.persisted)
        s4 = (k.groupBy(*CKEY).agg(F.max("BaseDateTime").alias("last_ts"),
                                   F.min_by(F.struct("LAT", "LON", "SOG"), "seq").alias("first_row"),
                                   F.bool_or(bad_stop_row()).alias("bad"))
              .select(*CKEY, F.last("last_ts", True).over(ca.rowsBetween(*BEFORE)).alias("_c_pt"),
                      F.last("first_row", True).over(cd.rowsBetween(*BEFORE)).alias("_c_n"),
                      F.bool_or("bad").over(Window.partitionBy(*VKEY)).alias("rejected")))
        k = _carry(k, s4)
        first_kept = F.col("_pseq").isNull()
        last_kept = F.col("_nseq").isNull()
        k = k.withColumns({
            "prev_time": F.when(first_kept, F.col("_c_pt")).otherwise(F.col("_pt")),
            **{f"next_{c}": F.when(last_kept, F.col("_c_n")[c]).otherwise(F.col(f"_n_{c}"))
               for c in ("LAT", "LON", "SOG")}})
        k = k.drop("_pseq", "_pt", "_nseq", "_n_LAT", "_n_LON", "_n_SOG", "_c_pt", "_c_n")
        # the kept rows with their CO2 columns (a superset of the plain 'kept' stage)
        return co2_columns(k, self.p)

    @property
    def kept(self) -> DataFrame:
        return self.co2


def hot_stays(traj: DataFrame, bag: list) -> DataFrame:
    """Round 5 on hot, tagged rows: stay starts and route keys across chunks
    (same columns as ``routes.mark_stays``)."""
    ca, cd = _chunk_windows()
    wd = w_desc(CKEY)
    t = traj.withColumn("at_port", at_port())
    t = t.select("*", F.lead("seq", 1).over(wd).alias("_pseq"), F.lead("at_port", 1).over(wd).alias("_pap"))
    t = t.withColumn("_first", F.col("_pseq").isNull()) \
         .withColumn("_lstart", F.col("at_port") & ~F.col("_first") & ~F.col("_pap"))
    t = _keep(t, bag)
    info = F.struct(F.col("BaseDateTime").alias("t"), F.col("PortName").alias("port"),
                    F.col("State").alias("state"), F.col("CO2").alias("co2"))
    a = t.groupBy(*CKEY).agg(F.max_by("at_port", "seq").alias("last_ap"),
                             F.min_by(F.struct(F.col("at_port").alias("ap"), info.alias("i")), "seq").alias("fr"))
    b = (t.filter("_lstart").groupBy(*CKEY)
         .agg(F.count(F.lit(1)).alias("n_local"), F.min_by(info, "seq").alias("first_local")))
    s = a.join(b, CKEY, "left")
    s = s.select("*", F.lag("last_ap", 1).over(ca).alias("_prev_ap"))
    s = s.withColumn("first_is_start", F.col("fr.ap") & ~F.coalesce(F.col("_prev_ap"), F.lit(False)))
    s = (s.withColumn("starts_in", F.coalesce(F.col("n_local"), F.lit(0)) + F.col("first_is_start").cast("long"))
          .withColumn("first_start", F.when(F.col("first_is_start"), F.col("fr.i")).otherwise(F.col("first_local"))))
    s = s.select(*CKEY, "first_is_start",
                 F.coalesce(F.sum("starts_in").over(cd.rowsBetween(*BEFORE)), F.lit(0)).alias("_c_after"),
                 F.last("first_start", True).over(cd.rowsBetween(*BEFORE)).alias("_c_next"))
    t = _carry(t, s)
    t = t.withColumn("stay_start", F.col("_lstart") | (F.col("_first") & F.col("first_is_start")))
    after = wd.rowsBetween(*BEFORE)
    local_next = F.last(F.when(F.col("stay_start"), info), True).over(after)
    t = t.select("*",
                 (F.coalesce(F.sum(F.col("stay_start").cast("long")).over(after), F.lit(0))
                  + F.col("_c_after")).alias("route_key"),
                 F.coalesce(local_next, F.col("_c_next")).alias("_nx"))
    t = t.select("*", F.col("_nx.t").alias("next_time"), F.col("_nx.port").alias("next_port"),
                 F.col("_nx.state").alias("next_state"), F.col("_nx.co2").alias("next_co2"))
    return t.drop("_pseq", "_pap", "_first", "_lstart", "first_is_start", "_c_after", "_c_next", "_nx")
