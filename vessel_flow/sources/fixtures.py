"""Map the shared test tables to AIS shape (FIXTURES.md section 4).

``events`` becomes position reports and ``nation`` becomes 25 ports and 25
state boxes (2 x 2 degrees on a 5 x 5 grid).  Coordinates are built in whole
hundredths of a degree and divided once, so every engine gets the same
doubles.  The same rules are written in SQL for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import box_edges, ring_edges

#: Names of the fixture's states, in the order of ``n_nationkey``.
STATE_NAMES = [f"NATION_{k}" for k in range(25)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def burst_events(events: DataFrame) -> DataFrame:
    """``events`` with nine of ten users' rows moved into one minute."""
    minute = F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))
    moved = F.timestamp_add("MICROSECOND", (F.col("event_id") * 7919) % 60_000_000, minute)
    ts = F.col("ts").cast("timestamp_ntz")
    return events.withColumn("ts", F.when(F.col("user_id") % 10 != 0, moved).otherwise(ts))


def ais_from_events(events: DataFrame, type_rule: str = "freight", vessel: str = "user", nulls: bool = False,
                    extra: list[str] | None = None) -> DataFrame:
    """events -> AIS rows (MMSI, BaseDateTime, LAT, LON, SOG, VesselType).

    ``type_rule`` 'freight': 70 + user_id % 20; 'mixed': 60 + user_id % 40
    (half of the vessels fail the freight filter).  ``vessel`` 'user': one
    vessel per user; 'user_day': one per user and day (short tracks); 'one': a single one.  With
    ``nulls`` some rows have no speed, and every tenth vessel has no position
    on every third day, so that the null rules and the reject rule apply."""
    uid = F.col("user_id")
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp_ntz")
    slow0 = F.col("value") < 60
    pk = (uid + F.floor(F.dayofmonth(ts) / 3)) % 25
    lat_h = 2600 + 200 * F.floor(pk / 5) + F.when(slow0, 6 * (eid % 5)).otherwise(30 + eid % 50)
    lon_h = -9400 + 200 * (pk % 5) + F.when(slow0, F.lit(0)).otherwise(2 * (eid % 60))
    vtype = (70 + uid % 20) if type_rule == "freight" else (60 + uid % 40)
    mmsi = {"user": uid, "user_day": uid * 1000 + F.dayofyear(ts), "one": F.lit(1)}[vessel]
    sog = F.when(slow0, F.lit(0.1)).otherwise(F.col("value") / 10.0)
    if nulls:
        lost = (uid % 10 == 3) & (F.dayofmonth(ts) % 3 == 0)
        lat_h, lon_h = F.when(~lost, lat_h), F.when(~lost, lon_h)
        sog = F.when(eid % 11 != 5, sog)
    return events.select(
        mmsi.cast("long").alias("MMSI"),
        ts.alias("BaseDateTime"),
        (lat_h.cast("double") / 100.0).alias("LAT"),
        (lon_h.cast("double") / 100.0).alias("LON"),
        sog.alias("SOG"),
        vtype.cast("int").alias("VesselType"),
        *(extra or []),
    )


def _box(k):
    y0 = (25 + 2 * F.floor(k / 5)).cast("double")
    x0 = (-95 + 2 * (k % 5)).cast("double")
    return x0, y0, x0 + 2.0, y0 + 2.0


def states_from_nation(nation: DataFrame) -> DataFrame:
    """One closed 2 x 2 degree box per nation: rings(ordinal, name, edges)."""
    k = F.col("n_nationkey")
    x0, y0, x1, y1 = _box(k)
    return nation.select(k.cast("int").alias("ordinal"), F.col("n_name").alias("name"),
                         box_edges(x0, y0, x1, y1).alias("edges"))


def irregular_states(nation: DataFrame) -> DataFrame:
    """Triangles (even keys) and boxes with a hole (odd keys): one row per
    ring.  No position lies on an edge, so any exact test gives one answer."""
    k = F.col("n_nationkey")
    x0, y0, x1, y1 = _box(k)

    def ring(*points):
        return ring_edges(F.array(*[F.array(x, y) for x, y in points]))

    low, high = y0 - 0.005, y0 + 1.995
    outer = F.when(k % 2 == 0, ring((x0 - 0.012, low), (x0 + 1.988, high), (x0 - 0.012, high))).otherwise(
        ring((x0 - 0.005, low), (x0 + 2.005, low), (x0 + 2.005, high), (x0 - 0.005, high)))
    hx0, hx1, hy0, hy1 = x0 + 1.105, x0 + 1.505, y0 + 1.305, y0 + 1.605
    hole = F.when(k % 2 == 1, ring((hx0, hy0), (hx1, hy0), (hx1, hy1), (hx0, hy1)))
    rings = nation.select(k.cast("int").alias("ordinal"), F.col("n_name").alias("name"),
                          F.explode(F.array(outer, hole)).alias("edges"))
    return rings.where(F.col("edges").isNotNull())


def dense_states(nation: DataFrame, teeth: int = 1500) -> DataFrame:
    """Boxes whose lower border is a saw of ``teeth`` teeth, which cuts through
    the positions.  No position lies on an edge."""
    k = F.col("n_nationkey")
    x0, y0, x1, y1 = _box(k)
    step = 2.006 / (2 * teeth)
    saw = F.transform(F.sequence(F.lit(0), F.lit(2 * teeth)), lambda m: F.array(
        x0 - 0.003 + m.cast("double") * step, y0 + 1.0537 + F.when(m % 2 == 1, 0.5).otherwise(0.0)))
    high = y0 + 1.995
    ring = F.concat(saw, F.array(F.array(x0 + 2.003, high), F.array(x0 - 0.003, high)))
    return nation.select(k.cast("int").alias("ordinal"), F.col("n_name").alias("name"), ring_edges(ring).alias("edges"))


def ports_from_supplier(supplier: DataFrame) -> DataFrame:
    """One port per supplier, so that several are in reach of one position."""
    k = F.col("s_suppkey")
    return supplier.select(k.cast("int").alias("ordinal"), F.col("s_name").alias("name"),
                           F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("state"),
                           ((2500 + (k * 37) % 1000).cast("double") / 100.0).alias("lat"),
                           ((-9500 + (k * 53) % 1000).cast("double") / 100.0).alias("lon"))


def ports_from_nation(nation: DataFrame) -> DataFrame:
    """One port per nation at its box centre: (ordinal, name, state, lat, lon)."""
    k = F.col("n_nationkey")
    return nation.select(k.cast("int").alias("ordinal"),
                         F.concat(F.lit("PORT "), F.col("n_name")).alias("name"),
                         F.col("n_name").alias("state"),
                         (25 + 2 * F.floor(k / 5) + 1).cast("double").alias("lat"),
                         (-95 + 2 * (k % 5) + 1).cast("double").alias("lon"))


def world_ports_from_supplier(supplier: DataFrame) -> DataFrame:
    """A raw world port list with messy headers and country codes (S8):
    columns ' port_name', 'Latitude ', 'LONGITUDE', 'country', 'extra'."""
    k = F.col("s_suppkey")
    country = (F.when(F.col("s_nationkey") % 3 == 0, F.lit("US"))
               .when(F.col("s_nationkey") % 3 == 1, F.lit(" us "))
               .otherwise(F.lit("CA")))
    return supplier.select(
        F.col("s_name").alias(" port_name"),
        ((2500 + (k * 37) % 1000).cast("double") / 100.0).alias("Latitude "),
        ((-9500 + (k * 53) % 1000).cast("double") / 100.0).alias("LONGITUDE"),
        country.alias("country"),
        F.col("s_acctbal").alias("extra"),
    )


def shifted_events(events: DataFrame, unit: str, n: int) -> DataFrame:
    """``events`` dealt over three times, ``n`` units (YEAR, DAY) apart, by user."""
    ts = F.timestamp_add(unit, (F.col("user_id") % 3).cast("int") * n, F.col("ts").cast("timestamp_ntz"))
    return events.withColumn("ts", ts)


# --- the tables written as the files that the sources read --------------------

#: Headers of the daily files, by day of year modulo 4; the last lacks the type.
DAILY_HEADERS = [
    ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType"],
    ["VesselType", "SOG", "LON", "LAT", "BaseDateTime", "MMSI", "Heading", "IMO"],
    ["BaseDateTime", "Status", "MMSI", "LAT", "LON", "VesselType", "SOG"],
    ["MMSI", "BaseDateTime", "LAT", "LON", "SOG"],
]


def daily_rows(events: DataFrame) -> DataFrame:
    """(day, variant, event_id, line): the text line of every event.

    By ``event_id`` modulo 40 a line has a value too many (7), is cut off (13),
    has no time (21) or no whole vessel number (29); every fifth vessel number
    is written with a decimal point."""
    rows = ais_from_events(events, extra=["event_id"])
    k = F.col("event_id") % 40
    mmsi = F.col("MMSI").cast("string")
    text = {
        "MMSI": F.when(k == 29, F.concat(F.lit("x"), mmsi)).when(F.col("event_id") % 5 == 0, F.concat(mmsi, F.lit(".0")))
                 .otherwise(mmsi),
        "BaseDateTime": F.when(k == 21, F.lit("noon")).otherwise(
            F.date_format(F.col("BaseDateTime").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        "LAT": F.col("LAT").cast("decimal(9,2)").cast("string"), "LON": F.col("LON").cast("decimal(9,2)").cast("string"),
        "SOG": F.col("SOG").cast("decimal(18,6)").cast("string"), "VesselType": F.col("VesselType").cast("string"),
        "Heading": F.lit("511"), "IMO": F.concat(F.lit("IMO"), mmsi), "Status": F.lit("5"),
    }
    day = F.to_date("BaseDateTime")
    variant = F.dayofyear(day) % len(DAILY_HEADERS)
    line = F.lit(None).cast("string")
    for v, names in enumerate(DAILY_HEADERS):
        whole = F.concat_ws(",", *[text[c] for c in names])
        cut = F.concat_ws(",", *[text[c] for c in names[:3]])
        line = F.when(variant == v, F.when(k == 7, F.concat(whole, F.lit(",surplus"))).when(k == 13, cut)
                      .otherwise(whole)).otherwise(line)
    return rows.select(day.alias("day"), variant.alias("variant"), "event_id", line.alias("line"))


def _renamed(spark: SparkSession, folder: str, target: str) -> None:
    """Moves the part file of each folder ``stem=<name>`` to ``target/<name>``:
    a file for each day."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(target))
    for found in fs.globStatus(hadoop.Path(folder, "stem=*/part-*")):
        fs.rename(found.getPath(), hadoop.Path(target, found.getPath().getParent().getName()[5:]))


def write_daily_csv(events: DataFrame, folder: str) -> str:
    """A file ``AIS_yyyy_MM_dd.csv`` for each day of ``events``, with one of
    four headers and faulty lines; the folder's name."""
    rows = daily_rows(events)
    header = F.get(F.array(*[F.lit(",".join(h)) for h in DAILY_HEADERS]), F.col("variant"))
    heads = rows.select("day", "variant").distinct().select(
        "day", "variant", F.lit(-1).cast("long").alias("event_id"), header.alias("line"))
    stem = F.date_format("day", "'AIS_'yyyy_MM_dd'.csv'")
    (rows.unionByName(heads).select(stem.alias("stem"), "event_id", "line")
     .repartition("stem").sortWithinPartitions("stem", "event_id").select("stem", "line")
     .write.partitionBy("stem").text(f"{folder}/draft"))
    _renamed(events.sparkSession, f"{folder}/draft", f"{folder}/days")
    return f"{folder}/days"


def write_daily_zips(events: DataFrame, folder: str) -> str:
    """An archive ``AIS_yyyy_MM_dd.zip`` for each day of ``events``, in which
    every eighth of the vessels has a member of its own; the folder's name."""
    target = f"{folder}/zips"
    hadoop = events.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    hadoop.Path(target).getFileSystem(events.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop.Path(target))
    names = DAILY_HEADERS[0]

    def pack(pdf):
        import zipfile

        import pandas as pd
        from pyarrow import fs as pafs
        stem = pdf["stem"].iloc[0]
        to, path = pafs.FileSystem.from_uri(target if ":" in target.split("/")[0] else f"file://{target}")
        with to.open_output_stream(f"{path}/{stem}.zip") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "positions of one day")
            for part, rows in pdf.groupby("part"):
                z.writestr(f"{stem}_{part}.csv", "\n".join([",".join(names), *rows["line"]]))
        return pd.DataFrame({"rows": [len(pdf)]})

    ais = ais_from_events(events)
    line = F.concat_ws(",", F.col("MMSI").cast("string"), F.date_format(
        F.col("BaseDateTime").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("LAT").cast("string"),
        F.col("LON").cast("string"), F.col("SOG").cast("string"), F.col("VesselType").cast("string"))
    written = (ais.select(F.date_format("BaseDateTime", "'AIS_'yyyy_MM_dd").alias("stem"),
                          (F.col("MMSI") % 8).alias("part"), line.alias("line"))
               .groupBy("stem").applyInPandas(pack, "rows long"))
    written.agg(F.sum("rows")).first()
    return target


def write_geojson(nation: DataFrame, folder: str) -> str:
    """The state boxes as GeoJSON, a feature a line in the order of their keys."""
    k = F.col("n_nationkey")
    x0, y0, x1, y1 = _box(k)
    ring = F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name")).alias("properties"),
                       F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    nation.orderBy("n_nationkey").select(F.to_json(feature).alias("value")).coalesce(1).write.text(f"{folder}/states")
    return f"{folder}/states"
