"""Small builders shared by the tests."""

import datetime as dt

from pyspark.sql import types as T

AIS_SCHEMA = T.StructType([
    T.StructField("MMSI", T.LongType()), T.StructField("BaseDateTime", T.TimestampNTZType()),
    T.StructField("LAT", T.DoubleType()), T.StructField("LON", T.DoubleType()),
    T.StructField("SOG", T.DoubleType()), T.StructField("VesselType", T.IntegerType()),
])
RING_SCHEMA = "ordinal int, name string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"
PORT_SCHEMA = "ordinal int, name string, state string, lat double, lon double"
T0 = dt.datetime(2024, 3, 1, 0, 0, 0)


def box(x0, y0, x1, y1):
    x0, y0, x1, y1 = map(float, (x0, y0, x1, y1))
    return [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]


def ais(spark, rows):
    return spark.createDataFrame(rows, AIS_SCHEMA)


def rings(spark, polys):
    return spark.createDataFrame([(o, n, [tuple(e) for e in edges]) for o, n, edges in polys], RING_SCHEMA)


def ports(spark, ps):
    return spark.createDataFrame(ps, PORT_SCHEMA)


def track(mmsi, points, vtype=70, t0=T0):
    """points: (minutes from t0, lat, lon, sog)."""
    f = lambda v: None if v is None else float(v)
    return [(mmsi, t0 + dt.timedelta(minutes=m), f(la), f(lo), f(s), vtype) for m, la, lo, s in points]
