"""Plain-Python model of one vessel's processing, written as a sequential
fold over the sorted rows.  Used as a brute-force oracle for the window
plans on random tracks (small inputs only)."""

from __future__ import annotations

import math

from vessel_flow.params import DEFAULT


def median(vals):
    v = sorted(x for x in vals if x is not None)
    if not v:
        return None
    m = len(v) // 2
    return v[m] if len(v) % 2 else (v[m - 1] + v[m]) / 2


def smooth(rows, p=DEFAULT):
    n = len(rows)
    out = [dict(r) for r in rows]
    if n < p.smooth_min_rows:
        return out
    w = p.smooth_window
    lo, hi = -(w // 2), w - 1 - w // 2     # pandas' centred window
    for c in ("LAT", "LON", "SOG"):
        for i in range(n):
            out[i][c] = median([rows[j][c] for j in range(i + lo, i + hi + 1) if 0 <= j < n])
    return out


def hours(a, b):
    return (b - a).total_seconds() / 3600


def collapse(rows, p=DEFAULT):
    """rows sorted and smoothed -> kept rows with Label."""
    slow = [r["SOG"] is not None and r["SOG"] < p.slow_sog for r in rows]
    runs, i = [], 0
    while i < len(rows):
        if slow[i]:
            j = i
            while j + 1 < len(rows) and slow[j + 1]:
                j += 1
            if hours(rows[i]["BaseDateTime"], rows[j]["BaseDateTime"]) >= p.min_stop_hours:
                runs.append([i, j])
            i = j + 1
        else:
            i += 1
    merged = []
    for s, e in runs:
        if merged and hours(rows[merged[-1][1]]["BaseDateTime"], rows[s]["BaseDateTime"]) < p.merge_gap_hours:
            merged[-1][1] = e
        else:
            merged.append([s, e])
    label = ["0"] * len(rows)
    drop = set()
    for s, e in merged:
        label[s] = label[e] = "1"
        drop.update(range(s + 1, e))
    out = []
    for k, r in enumerate(rows):
        if k not in drop:
            d = dict(r)
            d["Label"] = label[k]
            out.append(d)
    return out


def haversine(la1, lo1, la2, lo2, r=3440.0):
    if None in (la1, lo1, la2, lo2):
        return None
    p1, l1, p2, l2 = map(math.radians, (la1, lo1, la2, lo2))
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 2 * math.asin(math.sqrt(a)) * r


def co2(rows, p=DEFAULT):
    if not rows:
        return rows
    tanker = p.tanker_type_min <= rows[0]["VesselType"] <= p.tanker_type_max
    for k, r in enumerate(rows):
        r["TimeDiff"] = 0.0 if k == 0 else hours(rows[k - 1]["BaseDateTime"], r["BaseDateTime"])
        nxt = rows[k + 1] if k + 1 < len(rows) else None
        if r["Label"] == "1":
            r["CO2"] = r["TimeDiff"] * p.aux_rate(tanker) * p.co2_factor
        else:
            d = haversine(r["LAT"], r["LON"], nxt["LAT"] if nxt else None, nxt["LON"] if nxt else None)
            d = 0.0 if d is None else d
            sp = None if nxt is None or r["SOG"] is None or nxt["SOG"] is None else (r["SOG"] + nxt["SOG"]) / 2
            sp = p.floor_speed if sp is None or sp == 0 else sp
            r["CO2"] = p.main_rate(tanker) * (d / sp) * p.co2_factor
    return rows


def point_in_poly(edges, x, y):
    inside = False
    for (x1, y1, x2, y2) in edges:
        if (x - x1) * (y2 - y1) == (y - y1) * (x2 - x1) and min(x1, x2) <= x <= max(x1, x2) \
                and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def tag(rows, polygons, ports, p=DEFAULT):
    """polygons: [(ordinal, name, edges)], ports: [(ordinal, name, state, lat, lon)]."""
    lim = math.radians(p.port_radius_deg)
    for r in rows:
        r["State"], r["PortName"] = None, None
        if r["LAT"] is not None and r["LON"] is not None:
            for o, name, edges in sorted(polygons):
                if point_in_poly(edges, r["LON"], r["LAT"]):
                    r["State"] = name
                    break
        if r["Label"] == "1" and r["LAT"] is not None and r["LON"] is not None:
            best = None
            for o, name, state, la, lo in ports:
                d = haversine(r["LAT"], r["LON"], la, lo, 1.0)
                if d <= lim and (best is None or (d, o) < best[0]):
                    best = ((d, o), name, state)
            if best:
                r["PortName"], r["State"] = best[1], best[2]
    return rows


def routes(rows):
    """-> list of (start_time, start_port, start_state, end_port, end_state, total, {state: co2})."""
    at = [r["Label"] == "1" and r["PortName"] is not None for r in rows]
    starts = [i for i in range(len(rows)) if at[i] and not (i > 0 and at[i - 1])]
    out = []
    for a, b in zip(starts, starts[1:]):
        s, e = rows[a], rows[b]
        if s["State"] is None or e["State"] is None:
            continue
        seg = rows[a:b + 1]
        total = sum(r["CO2"] for r in seg)
        per = {}
        for r in seg:
            if r["State"] is not None and r["State"] not in (s["State"], e["State"]):
                per[r["State"]] = per.get(r["State"], 0.0) + r["CO2"]
        per = {k: v for k, v in per.items() if v > 0}
        out.append((s["BaseDateTime"], s["PortName"], s["State"], e["PortName"], e["State"], total, per))
    return out


def vessel(rows, polygons, ports, p=DEFAULT):
    rows = sorted(rows, key=lambda r: (r["BaseDateTime"], r["LAT"], r["LON"], r["SOG"], r["VesselType"]))
    k = co2(collapse(smooth(rows, p), p), p)
    if any(r["Label"] == "1" and (r["LAT"] is None or r["LON"] is None) for r in k):
        return None
    return tag(k, polygons, ports, p)
