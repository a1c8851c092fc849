"""Build the port dimension from a raw world port list (C8: S8, P5-P7, J2, P9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .geo import bounded_broadcast, state_bytes, state_cells, with_hits

REQUIRED = ["PORT_NAME", "LATITUDE", "LONGITUDE", "COUNTRY"]
PORT_COLUMNS = ["Main Port Name", "state", "Latitude", "Longitude"]


def normalise_headers(df: DataFrame) -> DataFrame:
    """Upper-case and trim column names (P5)."""
    return df.toDF(*[c.strip().upper() for c in df.columns])


def require(df: DataFrame, cols: list[str]) -> None:
    """Fail with the columns found when a required one is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns {missing}. Found: {list(df.columns)}")


def build_ports(raw: DataFrame, rings: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """U.S. ports with their state: country 'US' after trim/upper (P7), then
    an inner point-in-polygon join that keeps every matching state (J2); a
    port outside all polygons drops out.  Columns as in the port CSV (P9)."""
    df = normalise_headers(raw)
    require(df, REQUIRED)
    us = (df.where(F.upper(F.trim(F.col("COUNTRY").cast("string"))) == "US")
          .select(F.col("PORT_NAME").alias("Main Port Name"),
                  F.col("LATITUDE").cast("double").alias("Latitude"),
                  F.col("LONGITUDE").cast("double").alias("Longitude")))
    cells = bounded_broadcast(state_cells(rings, p), p, state_bytes(rings, p))
    # every polygon of a uniform cell that holds the point counts, not only the first
    j = with_hits(us, cells, p, "Latitude", "Longitude", uniform=False)
    return (j.select("*", F.explode("_hits").alias("_hit"))
            .select("Main Port Name", F.col("_hit")["name"].alias("state"), "Latitude", "Longitude"))
