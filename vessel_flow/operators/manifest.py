"""Ingest manifest (C11: S12, S13, A13), re-aimed from the downloader.

The reference walks a calendar of one expected file per day, skips days
whose CSV already exists and is non-empty, unpacks the rest from zip
archives and tallies SUCCESS / SKIPPED / FAILED.  Here the calendar is a
generated DataFrame, the existing files a ``binaryFile`` listing, and the
to-do list and the tally are anti / left joins and a ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_STEM = "'AIS_'yyyy_MM_dd"  # daily file name without extension: AIS_YYYY_MM_DD


def calendar(years: DataFrame) -> DataFrame:
    """One row per day of every year in ``years(year)``: (year, day, file_stem)."""
    y = years.select(F.col("year").cast("int").alias("year")).where(F.col("year").isNotNull()).distinct()
    days = F.sequence(F.make_date(F.col("year"), F.lit(1), F.lit(1)),
                      F.make_date(F.col("year"), F.lit(12), F.lit(31)), F.expr("INTERVAL 1 DAY"))
    return (y.select("year", F.explode(days).alias("day"))
            .select("year", "day", F.date_format("day", FILE_STEM).alias("file_stem")))


def listing(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """Files under ``path`` as (day, length, path); the day is read from the
    ``AIS_YYYY_MM_DD`` name.  Only metadata is listed, not contents."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"AIS_*{suffix}")
             .option("recursiveFileLookup", "true").load(path).select("path", "length"))
    stem = F.regexp_extract(F.col("path"), r"AIS_(\d{4}_\d{2}_\d{2})", 1)
    return files.select(F.to_date(stem, "yyyy_MM_dd").alias("day"), "length", "path")


def listing_from_days(days: DataFrame) -> DataFrame:
    """A listing built from a column of days that have data (length > 0)."""
    return days.where(F.col("day").isNotNull()).groupBy("day").agg(F.count(F.lit(1)).alias("length"))


def missing_days(cal: DataFrame, present: DataFrame) -> DataFrame:
    """Calendar days without a non-empty file: the to-do list."""
    have = present.where(F.col("length") > 0).select("day")
    return cal.join(have, "day", "left_anti").select("year", "day", "file_stem")


def ingest_status(cal: DataFrame, present: DataFrame, archives: DataFrame | None) -> DataFrame:
    """Per day: SKIPPED (non-empty CSV present), SUCCESS (an archive holds a
    CSV for it), FAILED (neither) (A13)."""
    have = present.where(F.col("length") > 0).select("day").distinct().withColumn("_have", F.lit(True))
    out = cal.join(have, "day", "left")
    if archives is not None:
        arc = (archives.where(F.col("has_csv")).select("day").distinct().withColumn("_arc", F.lit(True)))
        out = out.join(arc, "day", "left")
    else:
        out = out.withColumn("_arc", F.lit(None).cast("boolean"))
    status = (F.when(F.col("_have"), F.lit("SKIPPED"))
              .when(F.col("_arc"), F.lit("SUCCESS")).otherwise(F.lit("FAILED")))
    return out.select("year", "day", "file_stem", status.alias("status"))


def tally(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def ingest_manifest(spark: SparkSession, csv_dir: str, years: list[int],
                    zip_dir: str | None = None, report: bool = False) -> dict[str, DataFrame]:
    """C11: expected daily files of ``years`` against what is present.

    Returns ``status`` (one row per day: SKIPPED / SUCCESS / FAILED),
    ``tally`` (files per status), ``todo`` (days without a non-empty CSV) and,
    with ``zip_dir``, ``archives`` (one status row per zip); with ``report``,
    ``dropped`` (rows, malformed rows and rows without vessel or time per
    file, R-Q15) and ``rejects`` (files that could not be read).  The years are
    a handful of ints from the caller, the rest are Spark listings and joins."""
    from ..sources.ais_csv import ingest_report, read_ais_csv, read_zipped_ais
    cal = calendar(spark.createDataFrame([(int(y),) for y in years], "year int"))
    present = listing(spark, csv_dir)
    archives = read_zipped_ais(spark, zip_dir)[1] if zip_dir else None
    status = ingest_status(cal, present, archives)
    out = {"status": status, "tally": tally(status), "todo": missing_days(cal, present)}
    if archives is not None:
        out["archives"] = archives
    if report:
        scan = read_ais_csv(spark, csv_dir)
        out["dropped"], out["rejects"] = ingest_report(scan.lines), scan.rejects
    return out
