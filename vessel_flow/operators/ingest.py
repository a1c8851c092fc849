"""Typed projection, freight filter and period keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import DEFAULT, Params

AIS_COLUMNS = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType"]
OPTIONAL_COLUMNS = ["Status", "IMO"]
KEY = ["period", "MMSI"]


def _to_ntz(df: DataFrame, name: str) -> Column:
    """Timestamps stay wall-clock (no zone): text or zoned values -> TIMESTAMP_NTZ."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.TimestampNTZType):
        return c
    if isinstance(dt, T.StringType):
        return c.try_cast(T.TimestampNTZType())
    return c.cast(T.TimestampNTZType())


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _num(df: DataFrame, name: str, t: T.DataType) -> Column:
    """Text -> number with ``try_cast`` (bad text becomes NULL).  A column that
    is numeric already keeps a plain widening cast, which Catalyst can unwrap
    so that filters on it reach the Parquet scan."""
    src = df.schema[name].dataType
    c = F.col(name)
    if src == t:
        v = c
    elif isinstance(t, T.LongType) and isinstance(src, (T.StringType, T.FloatType, T.DoubleType)):
        # "367000000.0" is a whole number too; anything with a fraction is not
        d = c.try_cast(T.DecimalType(38, 10))
        v = F.when(d == F.floor(d), d).try_cast(t)
    elif isinstance(src, _NUMERIC) and not (isinstance(t, T.LongType) and isinstance(src, (T.FloatType, T.DoubleType))):
        v = c.cast(t)
    else:
        v = c.try_cast(t)
    if isinstance(t, T.DoubleType) and isinstance(src, (T.StringType, T.FloatType, T.DoubleType)):
        v = F.nanvl(v, F.lit(None).cast(t))  # NaN -> NULL at ingest (integers hold no NaN)
    return v


def period_columns(ts: Column, period: str) -> list[Column]:
    year = F.year(ts)
    if period == "year":
        per = year
    elif period == "month":
        per = year * 100 + F.month(ts)
    else:
        raise ValueError(f"unknown period {period!r}")
    return [per.cast("int").alias("period"), year.cast("int").alias("year")]


def only_periods(df: DataFrame, periods: list[int], p: Params = DEFAULT) -> DataFrame:
    """Raw rows of the named periods.  A ``period`` column of the input (of
    the same kind, as ``streaming.incremental_ingest`` partitions by) prunes
    the scan; otherwise the time decides."""
    wanted = [int(x) for x in periods]
    if "period" in df.columns:
        return df.where(F.col("period").isin(wanted))
    return df.where(period_columns(_to_ntz(df, "BaseDateTime"), p.period)[0].isin(wanted))


def typed_ais(df: DataFrame, p: Params = DEFAULT, extra: list[str | Column] | None = None) -> DataFrame:
    """String or typed AIS rows -> typed rows.

    VesselType is read as a double first so that "70.0" survives; MMSI that is
    not a whole number becomes NULL.  Optional columns are kept if present, and
    the columns named in ``extra``.
    """
    cols = [
        _num(df, "MMSI", T.LongType()).alias("MMSI"),
        _to_ntz(df, "BaseDateTime").alias("BaseDateTime"),
        _num(df, "LAT", T.DoubleType()).alias("LAT"),
        _num(df, "LON", T.DoubleType()).alias("LON"),
        _num(df, "SOG", T.DoubleType()).alias("SOG"),
        _num(df, "VesselType", T.DoubleType()).alias("VesselType"),
    ]
    cols += [F.col(c) for c in OPTIONAL_COLUMNS if c in df.columns] + (extra or [])
    return df.select(*cols)


def freight_filter(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Keep cargo and tanker rows: 70 <= VesselType <= 89 on the unrounded
    value (a null type drops out), then type as int (P3)."""
    return (df.filter(F.col("VesselType").between(p.vessel_type_min, p.vessel_type_max))
            .withColumn("VesselType", F.col("VesselType").cast("int")))


def keyed(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Drop rows without vessel or time (R-Q15, R-Q17) and add period keys."""
    df = df.filter(F.col("MMSI").isNotNull() & F.col("BaseDateTime").isNotNull())
    return df.select(*period_columns(F.col("BaseDateTime"), p.period), *df.columns)


def ingest(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Raw AIS rows (text or typed) -> typed, filtered, keyed rows."""
    return keyed(freight_filter(typed_ais(df, p), p), p)


def partition_by_vessel(df: DataFrame, keys: list[str] = KEY, n: int | None = None) -> DataFrame:
    """The one hash exchange of the pipeline: every later window and group
    (on period, MMSI, ...) reuses this partitioning.

    The partition count is fixed to ``spark.sql.shuffle.partitions``: the
    stage after this exchange is CPU-heavy (two sorts, a dozen window
    functions, geometry tests) for few shuffled bytes, and AQE would
    otherwise coalesce it by bytes into a handful of tasks.  ``n`` (from
    ``Params.track_partitions``) sizes it apart from the small shuffles."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) for k in keys])
