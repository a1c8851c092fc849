"""Dimension and staged-table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import ring_edges
from ..sinks import TRAJECTORY_SCHEMA, stored

PORT_CSV_SCHEMA = "`Main Port Name` string, state string, Latitude double, Longitude double"


def read_ports_csv(spark: SparkSession, path: str) -> DataFrame:
    """The port dimension CSV (S6) -> (ordinal, name, state, lat, lon).

    ``ordinal`` is the row's position in the file (the nearest-port tie rule,
    R-Q8); the file is small and read as one split, so the position is stable."""
    df = (spark.read.schema(PORT_CSV_SCHEMA).option("header", True).csv(path)
          .coalesce(1).withColumn("ordinal", F.monotonically_increasing_id().cast("int")))
    return df.select("ordinal", F.col("Main Port Name").alias("name"), "state",
                     F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"))


GEOJSON_SCHEMA = ("type string, features array<struct<type: string, properties: map<string, string>, "
                  "geometry: struct<type: string, coordinates: string>>>")
FEATURE_SCHEMA = "type string, properties map<string, string>, geometry struct<type: string, coordinates: string>"


def read_states_geojson(spark: SparkSession, path: str, name_field: str = "name",
                        one_feature_per_line: bool = False) -> DataFrame:
    """State polygons from GeoJSON (S7) -> rings(ordinal, name, edges).

    Coordinates are kept as JSON text first so that Polygon and MultiPolygon
    features can share one schema, then parsed per type.  ``ordinal`` is the
    feature's position (the shared-border rule, R-Q20).  Coordinates are
    planar degrees (EPSG:4326), as GeoJSON defines."""
    if one_feature_per_line:
        # a dense number in the order of file, split and row; a map has a bounded number of features
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        lines = (spark.read.schema(FEATURE_SCHEMA).json(path)
                 .select(place.alias("place"), F.struct("type", "properties", "geometry").alias("f")))
        feats = lines.select((F.row_number().over(Window.orderBy("place")) - 1).alias("ordinal"), "f")
    else:
        fc = spark.read.schema(GEOJSON_SCHEMA).option("multiLine", True).json(path)
        feats = fc.select(F.posexplode("features").alias("ordinal", "f"))
    g = feats.select(F.col("ordinal").cast("int").alias("ordinal"),
                     F.col("f.properties").getItem(name_field).alias("name"),
                     F.col("f.geometry.type").alias("gtype"), F.col("f.geometry.coordinates").alias("coords"))
    poly = F.from_json("coords", "array<array<array<double>>>")
    multi = F.from_json("coords", "array<array<array<array<double>>>>")
    rings = F.when(F.col("gtype") == "Polygon", poly).when(F.col("gtype") == "MultiPolygon", F.flatten(multi))
    return (g.select("ordinal", "name", F.explode(rings).alias("ring"))
            .where(F.size("ring") >= 3)
            .select("ordinal", "name", ring_edges(F.col("ring")).alias("edges")))


def read_world_ports(spark: SparkSession, path: str) -> DataFrame:
    """Raw world port list (S8), every column as text."""
    return spark.read.option("header", True).csv(path)


def read_trajectory(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A staged trajectory (S9), written by ``sinks.write_trajectory``."""
    if fmt == "parquet":
        return stored(spark, path, TRAJECTORY_SCHEMA)
    # the 11 columns, in the file's own order of columns, with their types
    text = spark.read.option("header", True).csv(path)
    types = {c.split()[0]: c.split()[1] for c in TRAJECTORY_SCHEMA.split(", ")}
    return text.select(*[F.col(c).try_cast(types[c]).alias(c) for c in text.columns if c in types])


def read_period_outputs(spark: SparkSession, path: str) -> DataFrame:
    """All period outputs of a table (S10); partition columns come back as
    columns and differing columns merge by name."""
    return stored(spark, path)
