"""Cell joins against brute force: irregular polygons, holes, the
antimeridian, and the nearest port with its cut-off."""

import math
import random

import model
from helpers import rings
from vessel_flow.operators.geo import match_ports, port_cells, state_cells, tag_states
from vessel_flow.params import DEFAULT


def star(cx, cy, r0, r1, n, rnd):
    pts = []
    for k in range(n):
        a = 2 * math.pi * k / n
        r = rnd.uniform(r0, r1)
        pts.append((cx + r * math.cos(a), cy + r * math.sin(a)))
    return [(x1, y1, x2, y2) for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1])]


def test_irregular_polygons_match_brute_force(spark):
    rnd = random.Random(3)
    outer = star(10, 10, 2, 5, 40, rnd)
    hole = [(x2, y2, x1, y1) for x1, y1, x2, y2 in star(10, 10, 0.5, 1.2, 12, rnd)]
    polys = [(0, "A", outer + hole), (1, "B", star(15, 12, 1, 3, 25, rnd)),
             (2, "E", [(176.0, -2.0, 180.0, -2.0), (180.0, -2.0, 180.0, 2.0), (180.0, 2.0, 176.0, 2.0),
                       (176.0, 2.0, 176.0, -2.0)])]
    pts = [(rnd.uniform(3, 19), rnd.uniform(3, 17)) for _ in range(3000)]
    pts += [(rnd.uniform(175, 180), rnd.uniform(-3, 3)) for _ in range(300)] + [(-180.0, 0.0), (180.0, 0.5)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "LON double, LAT double")
    p = DEFAULT.with_(state_cell_deg=0.25)
    cells = state_cells(rings(spark, polys), p)
    uniform = {r["uniform_state"] for r in cells.filter("uniform").collect()}
    assert {"A", "B", None} <= uniform        # interior cells of both shapes and of the hole
    got = {(r["LON"], r["LAT"]): r["State"] for r in tag_states(df, cells, p).collect()}
    bad = [(x, y) for x, y in pts
           if got[(x, y)] != next((n for o, n, e in polys if model.point_in_poly(e, x, y)), None)]
    assert not bad, bad[:5]
    assert sum(v is not None for v in got.values()) > 500


def test_nearest_port_matches_brute_force(spark):
    rnd = random.Random(9)
    ports = [(k, f"P{k}", f"S{k % 3}", rnd.uniform(20, 22), rnd.uniform(-71, -69)) for k in range(60)]
    ports += [(60, "POLAR", "N", 71.3, 0.0), (61, "EDGE", "E", 0.0, 179.9)]
    pts = [(rnd.uniform(19.8, 22.2), rnd.uniform(-71.2, -68.8)) for _ in range(3000)]
    pts += [(71.3 + rnd.uniform(-0.3, 0.3), rnd.uniform(-1, 1)) for _ in range(200)]
    pts += [(rnd.uniform(-0.3, 0.3), rnd.choice([-1, 1]) * rnd.uniform(179.7, 180.0)) for _ in range(200)]
    df = spark.createDataFrame([(float(a), float(b), "1", None) for a, b in pts],
                               "LAT double, LON double, Label string, State string")
    pdf = spark.createDataFrame(ports, "ordinal int, name string, state string, lat double, lon double")
    got = {(r["LAT"], r["LON"]): r["PortName"] for r in match_ports(df, port_cells(pdf)).collect()}
    lim = math.radians(0.2)
    for a, b in pts:
        best = min(((model.haversine(a, b, la, lo, 1.0), o, n) for o, n, s, la, lo in ports), default=None)
        exp = best[2] if best and best[0] <= lim else None
        assert got[(a, b)] == exp, (a, b, best)


def test_fine_outlines_are_cut_into_strips(spark):
    """A strip holds a bounded number of edges, and the answer is that of brute force."""
    rnd = random.Random(11)
    polys = [(0, "A", star(10.3, 10.2, 3.4, 3.42, 3000, rnd)), (1, "B", star(13, 11, 2, 2.05, 700, rnd)),
             (2, "C", star(8.5, 8.5, 0.2, 0.4, 5, rnd))]
    pts = [(rnd.uniform(5, 17), rnd.uniform(5, 15)) for _ in range(1500)]
    pts += [(float(k), float(j)) for k in range(6, 16) for j in range(6, 15)] + [(x, y) for x, y, _, _ in polys[0][2][::50]]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "LON double, LAT double")
    p = DEFAULT.with_(cell_edges=16)
    cells = state_cells(rings(spark, polys), p)
    most = max(len(c["edges"]) for r in cells.collect() for strip in r["strips"] for c in strip)
    plain = max(len(c["edges"]) for r in state_cells(rings(spark, polys), DEFAULT.with_(cell_edges=10 ** 6)).collect()
                for strip in r["strips"] for c in strip)
    assert 3 * most < plain  # more than cell_edges where the outline runs along a parallel
    got = {(r["LON"], r["LAT"]): r["State"] for r in tag_states(df, cells, p).collect()}
    bad = [(x, y) for x, y in pts
           if got[(x, y)] != next((n for o, n, e in polys if model.point_in_poly(e, x, y)), None)]
    assert not bad, bad[:5]


def test_byte_bounds_hold(spark):
    from pyspark.sql import functions as F
    from vessel_flow.operators.geo import port_bytes, state_bytes
    rnd = random.Random(2)
    for n, p in ((30, DEFAULT), (900, DEFAULT.with_(cell_edges=16))):
        shape = rings(spark, [(0, "A", star(10, 10, 2, 5, n, rnd)), (1, "B", star(12, 12, 1, 2, 40, rnd))])
        size = F.aggregate(F.flatten("strips"), F.lit(0).cast("long"), lambda a, c: a + 96 + 32 * F.size(c["edges"]))
        real = state_cells(shape, p).agg(F.sum(size + 64)).first()[0]
        assert real <= state_bytes(shape, p).first()[0]
    ports = spark.createDataFrame([(k, f"P{k}", "S", rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for k in range(40)]
                                  + [(99, "POLE", "N", 89.95, 0.0)],
                                  "ordinal int, name string, state string, lat double, lon double")
    real = port_cells(ports).agg(F.sum(F.size("ports").cast("long") * 96 + 64)).first()[0]
    assert real <= port_bytes(ports).first()[0]


def test_a_saw_along_a_parallel_is_cut_into_columns(spark):
    """Teeth that every strip of latitude would hold; the answer is that of brute force."""
    rnd = random.Random(5)
    n = 1200
    saw = [(9.99 + k * 2.4 / n, 10.2 + 0.5 * (k % 2)) for k in range(n + 1)]
    pts = saw + [(12.39, 11.9), (9.99, 11.9)]
    flat = [(x1, y1, x2, y2) for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1])]
    upright = [(y1, x1 + 20, y2, x2 + 20) for x1, y1, x2, y2 in flat]
    polys = [(0, "FLAT", flat), (1, "UPRIGHT", upright), (2, "BELOW", [(9.5, 9.5, 13, 9.5), (13, 9.5, 13, 10.6),
                                                                     (13, 10.6, 9.5, 10.6), (9.5, 10.6, 9.5, 9.5)])]
    polys = [(o, m, [tuple(map(float, e)) for e in edges]) for o, m, edges in polys]
    at = [(rnd.uniform(9.8, 12.6), rnd.uniform(9.9, 12.1)) for _ in range(1200)]
    at += [(rnd.uniform(9.9, 12.1), rnd.uniform(29.8, 32.6)) for _ in range(800)]
    at += [(x, y) for x, y, _, _ in (flat + upright)[::40]] + [(float(x), 10.5) for x in (9, 10, 11, 12, 370, -350)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in at], "LON double, LAT double")
    cells = state_cells(rings(spark, polys))
    assert max(len(c["edges"]) for r in cells.collect() for strip in r["strips"] for c in strip) <= 2 * DEFAULT.cell_edges
    got = {(r["LON"], r["LAT"]): r["State"] for r in tag_states(df, cells).collect()}
    bad = [(x, y) for x, y in at
           if got[(x, y)] != next((m for o, m, e in polys if model.point_in_poly(e, x, y)), None)]
    assert not bad, bad[:5]


def test_dense_ports_are_cut_into_boxes(spark):
    """Ports of many densities, some at one position, some in a tight cluster: no box
    holds many but the cluster's, and the answer is that of brute force."""
    rnd = random.Random(21)
    at = [(rnd.uniform(20, 21), rnd.uniform(-71, -70)) for _ in range(1500)]
    at += at[:200] + [(20.5 + rnd.gauss(0, 0.01), -70.5 + rnd.gauss(0, 0.01)) for _ in range(150)]
    at += [(rnd.uniform(-0.3, 0.3), rnd.choice([-1, 1]) * rnd.uniform(179.7, 180.0)) for _ in range(150)]
    order = rnd.sample(range(len(at)), len(at))
    ports = [(k, f"P{k}", f"S{k % 3}", la, lo) for k, (la, lo) in zip(order, at)]
    pts = [(rnd.uniform(19.7, 21.3), rnd.uniform(-71.3, -69.7)) for _ in range(500)]
    pts += [(rnd.uniform(-0.3, 0.3), rnd.choice([-1, 1]) * rnd.uniform(179.7, 180.0)) for _ in range(150)]
    pts += [(la, lo) for la, lo in at[:50]] + [(20.5, -70.5), (20.25, -70.75), (0.0, 180.0), (0.0, -180.0)]
    df = spark.createDataFrame([(float(a), float(b), "1", None) for a, b in pts],
                               "LAT double, LON double, Label string, State string")
    pdf = spark.createDataFrame(ports, "ordinal int, name string, state string, lat double, lon double")
    cells = port_cells(pdf)
    sizes = sorted(len(r["ports"]) for r in cells.collect())
    assert sizes[-1] < 200 and sizes[int(len(sizes) * 0.9)] <= 2 * DEFAULT.cell_ports
    got = {(r["LAT"], r["LON"]): r["PortName"] for r in match_ports(df, cells).collect()}
    lim = math.radians(0.2)
    for a, b in pts:
        best = min((model.haversine(a, b, la, lo, 1.0), o, n) for o, n, s, la, lo in ports)
        assert got[(a, b)] == (best[2] if best[0] <= lim else None), (a, b, best)
