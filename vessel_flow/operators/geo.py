"""State tagging and port matching (C4: J1, J3, J6, J7, W11, O3).

Both are equi-joins on a grid cell against a dimension-sized cell table:

* states: each polygon ring's bounding box is spread over the cells it
  covers; a cell of many edges is cut into strips of latitude or columns of
  longitude, as many as keep one to about ``cell_edges`` edges of a polygon, so
  that a fine outline costs a point little more than a coarse one.  A strip holds
  the candidate polygons sorted by ordinal (name, the edges that a point there
  can meet, and the latitudes where the parity of those east of it changes).
  The exact test is a closed point-in-polygon over the edges; the lowest
  ordinal among matches wins (R-Q20).  A cell that no edge touches is
  decided once, at its centre.
* ports: each port is spread over the cells its 0.2 degree cap touches
  (longitude half-width asin(sin r / cos lat), wrapped at +-180).  The exact
  test is the great-circle angle <= r; the minimum of (angle, ordinal) wins,
  which equals "nearest, then cut off" (R-Q8, R-Q10).  Where ports are dense,
  a cell is cut into boxes that hold only ports which are nearest somewhere in
  the box.

A cell table has one row per cell, and a point reads one of the cell's boxes, so
the left joins never multiply track rows; its size depends only on the map and the port list.  It is
broadcast after its bytes are checked against ``broadcast_max_bytes``; a
larger one is joined by a shuffle on the cell key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import (cell_index, central_angle_sql, lon_cell_index, lon_half_width_deg,
                             point_in_edges_sql)
from ..params import DEFAULT, Params
from ..session import cut_lineage

_EPS = 1e-9
#: A cell has at most 2^MOST_SPLITS strips.
MOST_SPLITS = 10
#: A port cell has at most 2^MOST_LEVELS x 2^MOST_LEVELS boxes.
MOST_LEVELS = 8
#: The lists of a port cell's boxes hold at most so many times the ports of the cell.
MOST_GROWTH = 16


def bounded_broadcast(cells: DataFrame, p: Params = DEFAULT, most: DataFrame | None = None) -> DataFrame:
    """A cell table with a broadcast hint if its rows (a fixed part for each
    cell and candidate, 32 bytes for each edge) stay within the bound.

    ``most`` is an upper bound of those bytes from the map alone: if it already
    fits, nothing else is computed.  Otherwise the table is saved, so that the
    check and the joins compute it once, and measured."""
    if most is not None and (most.first()[0] or 0) <= p.broadcast_max_bytes:
        return F.broadcast(cells)
    cells = cut_lineage(cells)
    if "strips" in cells.columns:
        size = F.aggregate(F.flatten("strips"), F.lit(0).cast("long"), lambda a, c: a + 96 + 32 * F.size(c["edges"]))
    else:
        size = F.size("ports").cast("long") * 96
    total = cells.agg(F.sum(size + 64)).first()[0] or 0
    return F.broadcast(cells) if total <= p.broadcast_max_bytes else cells


def state_bytes(rings: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """At most so many bytes has ``state_cells``: each polygon in each cell of
    its rings' boxes, with all its edges in each strip."""
    s = p.state_cell_deg
    xmin, ymin, xmax, ymax = _ring_bbox(F.col("edges"))
    span = lambda lo, hi: cell_index(hi + _EPS, s) - cell_index(lo - _EPS, s) + 1
    polys = rings.groupBy("ordinal").agg(
        F.sum((span(xmin, xmax) * span(ymin, ymax)).cast("double")).alias("cells"), F.sum(F.size("edges")).alias("edges"))
    return polys.agg(F.sum(F.col("cells") * (160 + 32 * F.col("edges"))) * F.max(_strips(F.col("edges"), p)))


def _strips(edges: Column, p: Params) -> Column:
    """Number of strips of a cell whose polygons have at most so many edges: a
    power of two, so that the bounds are exact."""
    return F.when(edges <= p.cell_edges, 1).otherwise(F.pow(F.lit(2.0), F.least(
        F.ceil(F.log2(edges / F.lit(float(p.cell_edges)))), F.lit(MOST_SPLITS)))).cast("int")


def port_bytes(ports: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """At most so many bytes has ``port_cells``: each port in all its cells, and
    MOST_GROWTH times where they are cut into boxes."""
    ys, xs = _port_cover(p)
    most = 160 if _few(ports, p) else 160 * MOST_GROWTH
    return ports.agg(F.sum((F.size(ys) * F.size(xs)).cast("long") * most))


def _ring_bbox(edges):
    xs = F.transform(edges, lambda e: F.least(e.x1, e.x2))
    xe = F.transform(edges, lambda e: F.greatest(e.x1, e.x2))
    ys = F.transform(edges, lambda e: F.least(e.y1, e.y2))
    ye = F.transform(edges, lambda e: F.greatest(e.y1, e.y2))
    return F.array_min(xs), F.array_min(ys), F.array_max(xe), F.array_max(ye)


def state_cells(rings: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """rings(ordinal, name, edges) -> cells(cell_y, cell_x, strips).

    ``rings`` holds one row per ring (outer rings, holes, extra parts); a
    polygon is all rings of one ordinal."""
    s = p.state_cell_deg
    xmin, ymin, xmax, ymax = _ring_bbox(F.col("edges"))
    boxes = rings.select("ordinal", xmin.alias("xmin"), ymin.alias("ymin"),
                         xmax.alias("xmax"), ymax.alias("ymax"))
    cover = (boxes
             .withColumn("cell_y", F.explode(F.sequence(cell_index(F.col("ymin") - _EPS, s),
                                                        cell_index(F.col("ymax") + _EPS, s))))
             .withColumn("cx", F.explode(F.sequence(cell_index(F.col("xmin") - _EPS, s),
                                                    cell_index(F.col("xmax") + _EPS, s))))
             .select("ordinal", "cell_y", "cx", F.pmod("cx", F.lit(int(round(360 / s)))).alias("cell_x"))
             .distinct())
    polys = rings.groupBy("ordinal", "name").agg(F.flatten(F.collect_list("edges")).alias("edges"))
    # Only edges whose latitude range meets the cell's band can be crossed by
    # the test ray of a point in the cell, or hold it: keeping just those is
    # exact and shrinks both the broadcast and the per-point work.
    y0 = F.col("cell_y") * F.lit(float(s)) - _EPS
    y1 = (F.col("cell_y") + 1) * F.lit(float(s)) + _EPS
    # The ray goes towards +x, so edges that end before the cell are not met.
    # (Cells beyond +-180 degrees also serve points on the other side.)
    west = F.when(F.abs(F.col("cx") * F.lit(float(s)) + F.lit(s / 2)) < 180, F.col("cx") * F.lit(float(s)) - _EPS).otherwise(
        F.lit(float("-inf")))
    band = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= y0) & (F.least(e["y1"], e["y2"]) <= y1)
                    & (F.greatest(e["x1"], e["x2"]) >= west))
    rows = cover.join(polys, "ordinal").select("cell_y", "cell_x", "cx", "ordinal", "name", band.alias("edges"))
    # A cell that no candidate edge touches (edge boxes against the closed
    # cell, a superset test) has one answer for all its points: the lowest
    # polygon containing its centre.  Points there skip the edge test.
    x0, y0c, half = f"(cx * {float(s)!r}D)", f"(cell_y * {float(s)!r}D)", f"{float(s) / 2!r}D"
    touch = F.expr(f"exists(edges, e -> greatest(e.x1, e.x2) >= {x0} - {_EPS!r}D "
                   f"AND least(e.x1, e.x2) <= {x0} + {float(s)!r}D + {_EPS!r}D "
                   f"AND greatest(e.y1, e.y2) >= {y0c} - {_EPS!r}D "
                   f"AND least(e.y1, e.y2) <= {y0c} + {float(s)!r}D + {_EPS!r}D)")
    centre = F.expr(point_in_edges_sql("edges", f"({x0} + {half})", f"({y0c} + {half})"))
    rows = rows.select("*", touch.alias("_touch"), centre.alias("_centre"))
    cells = (rows.groupBy("cell_y", "cell_x")
             .agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "edges"))).alias("cands"),
                  F.max(F.size("edges")).alias("most"),
                  (~F.bool_or("_touch") & (F.count_distinct("cx") == 1)).alias("uniform"),
                  F.min("cx").alias("ucx"),
                  F.array_min(F.collect_list(F.when(F.col("_centre"), F.struct("ordinal", "name"))))
                  .getField("name").alias("uniform_state")))
    cells = cells.withColumn("n", _strips(F.col("most"), p))
    rest = ["cell_y", "cell_x", "uniform", "ucx", "uniform_state"]
    no_flips = F.array().cast("array<double>")
    plain = cells.where("n = 1").select(*rest, F.lit(False).alias("across"), F.array(F.transform(
        "cands", lambda c: F.struct(c["ordinal"], c["name"], c["edges"], no_flips.alias("flips")))).alias("strips"))
    finest = rings.groupBy("ordinal").agg(F.sum(F.size("edges")).alias("n")).agg(F.max("n")).first()[0] or 0
    if finest <= p.cell_edges:
        return plain
    wrapped = (F.count_distinct("cx") > 1) | F.bool_or(F.abs(F.col("cx") * F.lit(float(s)) + F.lit(s / 2)) >= 180)
    heads = cells.where("n > 1").drop("cands", "most").join(
        rows.groupBy("cell_y", "cell_x").agg(wrapped.alias("wrapped")), ["cell_y", "cell_x"])
    return cut_lineage(plain.unionByName(_cut_cells(heads, rows, s).select(*rest, "across", "strips")))


_CELL = ["cell_y", "cell_x"]
_CAND = [*_CELL, "cx", "ordinal", "name"]


def _cut_cells(heads: DataFrame, rows: DataFrame, s: float) -> DataFrame:
    """Cells of many edges in ``n`` boxes each: strips of latitude or columns of
    longitude (``across``), whichever leaves fewer edges in the fullest one.

    A box holds a polygon's edges that meet it.  Those wholly east of it are
    crossed by every ray of their latitudes, so only the parity of their ends at
    or below a point's latitude counts: ``flips`` are the latitudes of ends that
    do not cancel out (an outline that stays east leaves none).  A ``wrapped``
    cell also serves points of the other side: strips of all edges, no flips."""
    n, size = F.col("n"), F.lit(float(s))
    at = lambda v, cell: F.floor((v - F.col(cell) * size) * n / size).cast("int")
    inside = lambda v: F.greatest(F.lit(0), F.least(n - 1, v))
    east = at(F.least("e.x1", "e.x2") - _EPS, "cx")
    edge = (rows.select(*_CAND, F.explode("edges").alias("e"))
            .join(heads.select(*_CELL, "n", "wrapped"), _CELL)
            # columns west of ``x_lo`` have the edge wholly in their east
            .select("*", F.greatest(F.lit(0), F.least(n, east)).alias("x_lo"),
                    inside(at(F.greatest("e.x1", "e.x2") + _EPS, "cx")).alias("x_hi"),
                    inside(at(F.least("e.y1", "e.y2") - _EPS, "cell_y")).alias("y_lo"),
                    inside(at(F.greatest("e.y1", "e.y2") + _EPS, "cell_y")).alias("y_hi"))
            .withColumn("near", F.col("wrapped") | (F.col("x_lo") < n)))
    # the most edges of a strip and of a column: +1 where an edge begins, -1 after its end
    ends = F.array(*[F.struct(F.lit(axis == "x").alias("across"), pos.alias("pos"), F.lit(d).alias("d"))
                     for axis in "xy" for pos, d in ((F.col(f"{axis}_lo"), 1), (F.col(f"{axis}_hi") + 1, -1))])
    steps = (edge.where("near AND NOT wrapped").select(*_CELL, F.inline(ends)).groupBy(*_CELL, "across", "pos")
             .agg(F.sum("d").alias("d")))
    depth = F.sum("d").over(Window.partitionBy(*_CELL, "across").orderBy("pos"))
    most = (steps.select(*_CELL, "across", depth.alias("most")).groupBy(*_CELL)
            .agg((F.max(F.when(F.col("across"), F.col("most"))) < F.max(F.when(~F.col("across"), F.col("most")))).alias("across")))
    heads = heads.join(most, _CELL, "left").withColumn("across", F.coalesce("across", F.lit(False)))
    edge = edge.join(heads.select(*_CELL, "across"), _CELL)
    boxes = F.when(F.col("across"), F.sequence("x_lo", F.greatest("x_lo", "x_hi"))).otherwise(F.sequence("y_lo", "y_hi"))
    held = (edge.where("near").select(*_CAND, F.explode(boxes).alias("box"), "e")
            .groupBy(*_CAND, "box").agg(F.collect_list("e").alias("edges")))
    # an end's latitude counts in the columns that have an odd number of such ends in their east
    columns = F.when(F.col("across"), n).otherwise(F.lit(1))
    reach = F.when(F.col("across"), F.col("x_lo")).otherwise((F.col("x_lo") >= n).cast("int"))
    odd = F.filter(F.sequence(F.lit(0), F.col("columns") - 1),
                   lambda j: F.size(F.filter("reach", lambda r: r > j)) % 2 == 1)
    flips = (edge.where(~F.col("wrapped") & (reach > 0))
             .select(*_CAND, columns.alias("columns"), reach.alias("reach"), F.explode(F.array("e.y1", "e.y2")).alias("y"))
             .groupBy(*_CAND, "columns", "y").agg(F.collect_list("reach").alias("reach"))
             .select(*_CAND, F.explode(odd).alias("column"), "y")
             .groupBy(*_CAND, "column").agg(F.collect_list("y").alias("ys")))
    cands = (rows.select(*_CAND).join(heads.select(*_CELL, "n", "across"), _CELL)
             .withColumn("box", F.explode(F.sequence(F.lit(0), n - 1)))
             .withColumn("column", F.when(F.col("across"), F.col("box")).otherwise(F.lit(0))))
    # latitudes below the box count at all its points
    part = F.when(F.col("across"), F.lit(0)).otherwise(F.col("box"))
    parts = F.when(F.col("across"), F.lit(1)).otherwise(n)
    low = F.col("cell_y") * size + part * size / parts - _EPS
    high = F.col("cell_y") * size + (part + 1) * size / parts + _EPS
    base = F.when(F.size(F.filter("ys", lambda y: y <= F.col("low"))) % 2 == 1, F.array(F.lit(float("-inf"))))
    kept = F.concat(F.coalesce(base, F.array().cast("array<double>")),
                    F.filter("ys", lambda y: (y > F.col("low")) & (y <= F.col("high"))))
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    filled = (cands.join(held, [*_CAND, "box"], "left").join(flips, [*_CAND, "column"], "left")
              .withColumns({"low": low, "high": high})
              .select(*_CAND, "box", F.coalesce("edges", none).alias("edges"),
                      F.coalesce(kept, F.array().cast("array<double>")).alias("flips"))
              .where("size(edges) > 0 OR size(flips) > 0")
              .groupBy(*_CELL, "box")
              .agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "edges", "flips"))).alias("cands"))
              .groupBy(*_CELL).agg(F.map_from_entries(F.collect_list(F.struct("box", "cands"))).alias("m")))
    empty = F.array().cast("array<struct<ordinal:int,name:string,edges:array<struct<x1:double,y1:double,x2:double,y2:double>>,"
                           "flips:array<double>>>")
    all_boxes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at("m", i), empty))
    return heads.join(filled, _CELL, "left").select(
        *_CELL, "uniform", F.when(F.col("wrapped"), F.lit(None)).otherwise(F.col("ucx")).cast("int").alias("ucx"),
        "uniform_state", "across", all_boxes.alias("strips"))


def with_hits(df: DataFrame, cells: DataFrame, p: Params, lat: str, lon: str, uniform: bool = True) -> DataFrame:
    """Left join: ``_state`` of a uniform cell (with ``_same``), else ``_hits``, the
    polygons that hold the point.  A point reads its cell's head, then the one
    box that it lies in: a row carries no other box.  Without ``uniform`` all
    points are tested."""
    s = p.state_cell_deg
    head = cells.select("cell_y", "cell_x", "across", "uniform", "ucx", F.col("uniform_state").alias("_state"),
                        F.size("strips").alias("_n"))
    box = cells.select(
        F.col("cell_y").alias("_by"), F.col("cell_x").alias("_bx"), F.posexplode("strips").alias("_bi", "_cands"))
    j = (df.withColumn("_cy", cell_index(F.col(lat), s)).withColumn("_cx", lon_cell_index(F.col(lon), s)))
    j = j.join(F.broadcast(head), (F.col("_cy") == F.col("cell_y")) & (F.col("_cx") == F.col("cell_x")), "left")
    at = F.when(F.col("across"), F.col(lon) / F.lit(float(s)) - F.col("ucx")).otherwise(F.col(lat) / F.lit(float(s)) - F.col("cell_y"))
    here = F.col("ucx").isNull() | (F.col("_n") == 1) | (cell_index(F.col(lon), s) == F.col("ucx"))
    j = j.withColumn("_same", F.coalesce(F.lit(uniform) & F.col("uniform") & (cell_index(F.col(lon), s) == F.col("ucx")), F.lit(False)))
    j = j.withColumn("_at", F.when(here & ~F.col("_same"), F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.floor(
        at * F.col("_n")).cast("int")))))
    j = j.join(box, (F.col("_cy") == F.col("_by")) & (F.col("_cx") == F.col("_bx")) & (F.col("_at") == F.col("_bi")), "left")
    hit = point_in_edges_sql("k.edges", f"`{lon}`", f"`{lat}`", "k.flips")
    return (j.withColumn("_hits", F.expr(f"filter(_cands, k -> {hit})"))
             .drop("_cy", "_cx", "cell_y", "cell_x", "across", "uniform", "ucx", "_n", "_at", "_by", "_bx", "_bi", "_cands"))


def tag_states(df: DataFrame, cells: DataFrame, p: Params = DEFAULT,
               lat: str = "LAT", lon: str = "LON", out: str = "State") -> DataFrame:
    """Left join: ``out`` = name of the lowest-ordinal polygon containing the
    point (boundary included), null at sea or without coordinates (J1, W11)."""
    j = with_hits(df, cells, p, lat, lon)
    state = F.when(F.col("_same"), F.col("_state")).otherwise(F.try_element_at("_hits", F.lit(1)).getField("name"))
    return j.withColumn(out, state).drop("_same", "_state", "_hits")


def port_cells(ports: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """ports(ordinal, name, state, lat, lon) -> cells(cell_y, cell_x, ports); with
    more than ``cell_ports`` ports a row for each box of a cell (see ``_port_boxes``)."""
    ys, xs = _port_cover(p)
    few = _few(ports, p)
    if not few:  # of ports at one position only the first can be the nearest
        ports = (ports.groupBy("lat", "lon").agg(F.min(F.struct("ordinal", "name", "state")).alias("k"))
                 .select("k.ordinal", "k.name", "k.state", "lat", "lon"))
    cells = (ports.select("ordinal", "name", "state", "lat", "lon",
                          F.explode(ys).alias("cell_y"), xs.alias("_xs"))
             .select("*", F.explode("_xs").alias("cell_x")).drop("_xs")
             .groupBy("cell_y", "cell_x")
             .agg(F.collect_list(F.struct("ordinal", "name", "state", "lat", "lon")).alias("ports")))
    return cells if few else _port_boxes(cells, p)


def _few(ports: DataFrame, p: Params) -> bool:
    return ports.limit(p.cell_ports + 1).count() <= p.cell_ports


def _nearest_candidates(boxes: DataFrame, p: Params) -> DataFrame:
    """Drops the ports that are nearest to no point of their box: no point lies
    farther than ``rho`` from the centre, so a port farther from it than the
    centre's nearest port by more than 2 ``rho`` is never the nearest, and one
    beyond the radius by more than ``rho`` is out of reach."""
    s = float(p.port_cell_deg)
    n = F.col("n")
    rho = F.lit(math.radians(s) * math.sqrt(0.5)) / n
    angle = central_angle_sql("_lat", "_lon", "q.lat", "q.lon")
    near = F.least(F.array_min("_d.d") + 2 * rho, F.lit(math.radians(p.port_radius_deg)) + rho) + F.lit(_EPS)
    return (boxes.withColumn("_lat", (F.col("cell_y") + (F.col("box_y") + 0.5) / n) * s)
            .withColumn("_lon", (F.col("cell_x") + (F.col("box_x") + 0.5) / n) * s)
            .withColumn("_d", F.expr(f"transform(ports, q -> named_struct('d', {angle}, 'q', q))"))
            .withColumn("_near", near)
            .withColumn("ports", F.expr("transform(filter(_d, c -> c.d <= _near), c -> c.q)"))
            .drop("_lat", "_lon", "_d", "_near").where("size(ports) > 0"))


def _port_boxes(cells: DataFrame, p: Params) -> DataFrame:
    """cells(cell_y, cell_x, ports) -> (cell_y, cell_x, n, box_y, box_x, ports): a
    cell in n x n boxes, each with the ports that are nearest to some point in it.

    A cell is quartered while a box of it has more than ``cell_ports`` ports and its
    lists stay within MOST_GROWTH times the cell's own one (ports may be too close
    together to part), so a point's work does not grow with the port list, nor the
    table faster than it."""
    cell = ["cell_y", "cell_x"]
    one = cells.select(*cell, F.lit(1).alias("n"), F.lit(0).alias("box_y"), F.lit(0).alias("box_x"), "ports")
    boxes = cut_lineage(_nearest_candidates(one, p)
                        .withColumns({"more": F.size("ports") > p.cell_ports, "base": F.size("ports").cast("long")}))
    for _ in range(MOST_LEVELS):
        if boxes.where("more").isEmpty():
            break
        quarter = F.explode(F.array(*[F.struct((F.col("box_y") * 2 + i).alias("box_y"), (F.col("box_x") * 2 + j).alias("box_x"))
                                      for i in (0, 1) for j in (0, 1)])).alias("_q")
        finer = cut_lineage(_nearest_candidates(
            boxes.where("more").select(*cell, "base", (F.col("n") * 2).alias("n"), quarter, "ports")
            .select(*cell, "base", "n", "_q.box_y", "_q.box_x", "ports"), p))
        told = finer.groupBy(*cell).agg(
            (F.sum(F.size("ports").cast("long")) <= MOST_GROWTH * F.first("base")).alias("_good"),
            (F.max(F.size("ports")) > p.cell_ports).alias("_more"))
        kept = (boxes.join(told, cell, "left").where("NOT coalesce(_good, false)")
                .withColumn("more", F.lit(False)).drop("_good", "_more"))
        boxes = cut_lineage(kept.unionByName(finer.join(told.where("_good"), cell).withColumn("more", F.col("_more"))
                                             .drop("_good", "_more")))
    return boxes.drop("more", "base")


def _port_cover(p: Params) -> tuple[Column, Column]:
    """Rows and columns of the cells that a port's cap touches."""
    s = p.port_cell_deg
    r = p.port_radius_deg
    ncols = int(round(360 / s))
    hw = lon_half_width_deg(F.col("lat"), r)
    lo = cell_index(F.col("lon") - hw - _EPS, s)
    hi = cell_index(F.col("lon") + hw + _EPS, s)
    full = hw.isNull() | (hi - lo + 1 >= ncols)
    xs = F.when(full, F.sequence(F.lit(0), F.lit(ncols - 1))) \
        .otherwise(F.transform(F.sequence(lo, hi), lambda v: F.pmod(v, F.lit(ncols))))
    ys = F.sequence(cell_index(F.greatest(F.col("lat") - r - _EPS, F.lit(-90.0)), s),
                    cell_index(F.least(F.col("lat") + r + _EPS, F.lit(90.0)), s))
    return ys, xs


def match_ports(df: DataFrame, cells: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Nearest port within the radius for stop rows (Label '1'); a match sets
    ``PortName`` and overrides ``State`` with the port's state (J3, J6, O3)."""
    s = p.port_cell_deg
    limit = math.radians(p.port_radius_deg)
    pts = (df.withColumn("_cy", cell_index(F.col("LAT"), s))
             .withColumn("_cx", lon_cell_index(F.col("LON"), s)))
    on = (F.col("_cy") == F.col("cell_y")) & (F.col("_cx") == F.col("cell_x")) & (F.col("Label") == F.lit("1"))
    if "n" in cells.columns:
        heads = cells.groupBy(F.col("cell_y").alias("_hy"), F.col("cell_x").alias("_hx")).agg(F.first("n").alias("_n"))
        pts = pts.join(F.broadcast(heads), (F.col("_cy") == F.col("_hy")) & (F.col("_cx") == F.col("_hx")), "left")
        at = lambda v: F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.floor(
            (v / F.lit(float(s)) - F.floor(v / F.lit(float(s)))) * F.col("_n")).cast("int")))
        pts = pts.withColumn("_by", at(F.col("LAT"))).withColumn("_bx", at(F.col("LON"))).drop("_hy", "_hx", "_n")
        on = on & (F.col("_by") == F.col("box_y")) & (F.col("_bx") == F.col("box_x"))
    j = pts.join(cells, on, "left")
    angle = central_angle_sql("LAT", "LON", "q.lat", "q.lon")
    best = F.expr(f"array_min(filter(transform(ports, q -> named_struct('d', {angle}, 'ordinal', q.ordinal, "
                  f"'name', q.name, 'state', q.state)), q -> q.d <= {limit!r}D))")
    j = j.withColumn("_best", best)
    return (j.withColumn("PortName", F.col("_best").getField("name"))
             .withColumn("State", F.coalesce(F.col("_best").getField("state"), F.col("State")))
             .drop("_cy", "_cx", "_by", "_bx", "cell_y", "cell_x", "n", "box_y", "box_x", "ports", "_best"))
