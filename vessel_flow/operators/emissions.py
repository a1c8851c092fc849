"""Row CO2 on the collapsed track (C3: A11, W7, W8, F1-F6) and the vessel
reject rule (X5, R-Q7).  One descending window pass over the kept rows:
"previous" is ``lead`` and "next" is ``lag`` in that order, so the sort of
the stop pass is reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.emission import is_tanker, mean_speed, move_emission, stop_emission
from ..functions.geo import haversine_nm
from ..params import DEFAULT, Params
from .ingest import KEY
from .tracks import MICROS_PER_HOUR, micros_between, w_desc, w_vessel

TRAJECTORY_COLUMNS = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType",
                      "Label", "TimeDiff", "CO2", "State", "PortName"]


def estimate_co2(kept: DataFrame, p: Params = DEFAULT, key=KEY) -> DataFrame:
    """Adds ``prev_time``, ``next_LAT/LON/SOG``, ``TimeDiff`` (h, first row 0),
    ``distance_nm``, ``speed_mean``, ``tanker``, ``CO2`` (t) and ``rejected``
    (the vessel has a stop row without coordinates)."""
    w = w_desc(key)
    df = kept.select(
        "*",
        F.lead("BaseDateTime", 1).over(w).alias("prev_time"),
        F.lag("LAT", 1).over(w).alias("next_LAT"),
        F.lag("LON", 1).over(w).alias("next_LON"),
        F.lag("SOG", 1).over(w).alias("next_SOG"),
        F.bool_or(bad_stop_row()).over(w_vessel(key)).alias("rejected"),
    )
    return co2_columns(df, p)


def bad_stop_row():
    """A stop row without coordinates: the reference's nearest-port query
    fails on it and the vessel is dropped (R-Q7)."""
    return (F.col("Label") == "1") & (F.col("LAT").isNull() | F.col("LON").isNull())


def co2_columns(df: DataFrame, p: Params) -> DataFrame:
    """TimeDiff, distance, mean speed and CO2 from ``prev_time`` and the
    ``next_*`` columns."""
    td = F.coalesce(micros_between(F.col("prev_time"), F.col("BaseDateTime"))
                    / F.lit(float(MICROS_PER_HOUR)), F.lit(0.0))
    dist = F.coalesce(F.nanvl(haversine_nm("LAT", "LON", "next_LAT", "next_LON", p.earth_radius_nm),
                              F.lit(None).cast("double")), F.lit(0.0))
    df = (df.withColumn("TimeDiff", td)
            .withColumn("distance_nm", dist)
            .withColumn("speed_mean", mean_speed(F.col("SOG"), F.col("next_SOG"), p))
            .withColumn("tanker", is_tanker(F.col("first_type"), p)))
    co2 = F.when(F.col("Label") == "1", stop_emission(F.col("TimeDiff"), F.col("tanker"), p)) \
        .otherwise(move_emission(F.col("distance_nm"), F.col("speed_mean"), F.col("tanker"), p))
    return df.withColumn("CO2", F.coalesce(F.nanvl(co2, F.lit(None).cast("double")), F.lit(0.0)))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, one row per rejected vessel)."""
    rejects = (df.filter(F.col("rejected"))
               .groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"),
                                  F.count_if((F.col("Label") == "1") & (F.col("LAT").isNull()
                                                                       | F.col("LON").isNull()))
                                  .alias("stop_rows_without_position"))
               .withColumn("reason", F.lit("stop row without coordinates")))
    return df.filter(~F.col("rejected")), rejects
