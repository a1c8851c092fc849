"""Geometry expressions, all JVM-side (no Python per row).

Polygons are carried as an array of edges ``struct<x1,y1,x2,y2>`` (x = lon,
y = lat, planar degrees).  All rings of a polygon, holes and extra parts
included, go into one edge array: the even-odd rule then handles holes and
multi-part shapes without knowing which ring is which.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2")])
EDGES = T.ArrayType(EDGE)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def central_angle_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle angle in radians (haversine form) as a SQL expression over
    column names or lambda fields; one parse instead of dozens of calls."""
    p1, l1, p2, l2 = (f"radians({v})" for v in (lat1, lon1, lat2, lon2))
    return (f"(asin(sqrt(pow(sin(({p2} - {p1}) / 2), 2) + cos({p1}) * cos({p2}) * "
            f"pow(sin(({l2} - {l1}) / 2), 2))) * 2)")


def central_angle(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle angle in radians (haversine form)."""
    if all(isinstance(v, str) for v in (lat1, lon1, lat2, lon2)):
        return F.expr(central_angle_sql(lat1, lon1, lat2, lon2))
    p1, l1, p2, l2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    dlon = l2 - l1
    dlat = p2 - p1
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.asin(F.sqrt(a)) * 2


def haversine_nm(lat1, lon1, lat2, lon2, radius_nm: float = 3440.0) -> Column:
    """Great-circle distance in nautical miles; null if any input is null."""
    return central_angle(lat1, lon1, lat2, lon2) * F.lit(float(radius_nm))


def point_in_edges_sql(edges: str, x: str, y: str, flips: str | None = None) -> str:
    """Closed point-in-polygon test as SQL: on an edge, or an odd number of
    crossings.  ``edges`` is an array of ``struct<x1,y1,x2,y2>``.  The ray goes
    towards +x; a horizontal edge never counts as crossed (``nullif`` keeps
    ANSI division safe), and the half-open rule ``(y1 > y) != (y2 > y)`` counts
    a vertex once.  ``flips``, an array of latitudes, stands for edges that are
    wholly east of the point: each one at or below ``y`` changes the parity."""
    on_edge = (f"(({x} - e.x1) * (e.y2 - e.y1) = ({y} - e.y1) * (e.x2 - e.x1) "
               f"AND {x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) "
               f"AND {y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))")
    crosses = (f"((e.y1 > {y}) != (e.y2 > {y}) "
               f"AND {x} < (e.x2 - e.x1) * ({y} - e.y1) / nullif(e.y2 - e.y1, 0D) + e.x1)")
    return (f"(exists({edges}, e -> {on_edge}) OR "
            f"(aggregate({edges}, 0, (acc, e) -> acc + CASE WHEN {crosses} THEN 1 ELSE 0 END)"
            + (f" + size(filter({flips}, f -> f <= {y}))" if flips else "") + ") % 2 = 1)")


def ring_edges(ring: Column) -> Column:
    """``array<array<double>>`` ring of ``[x, y]`` vertices -> edge array.

    The ring is closed if its last vertex differs from its first.
    """
    n = F.size(ring)
    closed = F.when(
        (ring[0][0] == ring[n - 1][0]) & (ring[0][1] == ring[n - 1][1]), ring
    ).otherwise(F.concat(ring, F.array(ring[0])))
    m = F.size(closed)
    starts = F.slice(closed, 1, m - 1)
    ends = F.slice(closed, 2, m - 1)
    return F.zip_with(starts, ends, lambda a, b: F.struct(
        a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))


def box_edges(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed axis-aligned rectangle as four edges."""
    def e(ax, ay, bx, by):
        return F.struct(ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))
    return F.array(e(x0, y0, x1, y0), e(x1, y0, x1, y1), e(x1, y1, x0, y1), e(x0, y1, x0, y0))


def lon_half_width_deg(lat_deg: Column, radius_deg: float) -> Column:
    """Longitude half-width of a spherical cap of ``radius_deg`` at ``lat_deg``.

    asin(sin r / cos lat); null when the cap reaches a pole (whole circle).
    """
    s = math.sin(math.radians(radius_deg))
    c = F.cos(F.radians(lat_deg))
    return F.when(c > F.lit(s), F.degrees(F.asin(F.lit(s) / c)))


def cell_index(v: Column, size_deg: float) -> Column:
    return F.floor(v / F.lit(float(size_deg))).cast("int")


def lon_cell_index(lon: Column, size_deg: float) -> Column:
    """Longitude cell, wrapped so that -180 and +180 share a cell."""
    ncols = int(round(360.0 / size_deg))
    return F.pmod(cell_index(lon, size_deg), F.lit(ncols))
