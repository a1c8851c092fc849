"""DuckDB SQL for every registered query: the correctness oracle.

The SQL restates each rule independently of the Spark plan where that is
practical: stops are merged on a table of runs (not by row scans), state
boxes are a coordinate range test (not an edge array), the nearest port is
a brute-force minimum over all ports, and routes are inclusive row ranges
between consecutive stay starts, as in the reference.  Doubles are rounded
to 6 places on both sides.
"""

from __future__ import annotations

from ..params import DEFAULT, Params

R = 6  # decimal places compared


def _d(x: float) -> str:
    """A double literal that parses to exactly the same double."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _rd(expr: str, alias: str) -> str:
    return f"round({expr}, {R}) AS {alias}"


#: Polygon of a state as a condition on a row ``a`` and the state's box ``b``.
BOX = "a.LON BETWEEN b.x0 AND b.x0 + 2 AND a.LAT BETWEEN b.y0 AND b.y0 + 2"
IRREGULAR = """a.LON >= b.x0 - 0.005 AND a.LAT <= b.y0 + 1.995 AND CASE WHEN b.ordinal % 2 = 0
  THEN a.LAT - b.y0 + 0.005 >= a.LON - b.x0 + 0.012
  ELSE a.LON <= b.x0 + 2.005 AND a.LAT >= b.y0 - 0.005 AND NOT (a.LON BETWEEN b.x0 + 1.105 AND b.x0 + 1.505
       AND a.LAT BETWEEN b.y0 + 1.305 AND b.y0 + 1.605) END"""
#: ``fixtures.dense_states``: above the saw, whose height is linear on each half tooth.
DENSE = """a.LON >= b.x0 - 0.003 AND a.LON <= b.x0 + 2.003 AND a.LAT <= b.y0 + 1.995 AND a.LAT >= b.y0 + 1.0537
  + 0.5 * (1 - abs(2 * ((a.LON - b.x0 + 0.003) * 1500 / 2.006 - floor((a.LON - b.x0 + 0.003) * 1500 / 2.006)) - 1))"""
NATION_PORTS = """
      SELECT n_nationkey AS ordinal, 'PORT ' || n_name AS name, n_name AS state,
             CAST(25 + 2 * (n_nationkey // 5) + 1 AS DOUBLE) AS lat,
             CAST(-95 + 2 * (n_nationkey % 5) + 1 AS DOUBLE) AS lon
      FROM nation"""
SUPPLIER_PORTS = """
      SELECT s_suppkey AS ordinal, s_name AS name, 'NATION_' || s_nationkey AS state,
             CAST(2500 + (s_suppkey * 37) % 1000 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
             CAST(-9500 + (s_suppkey * 53) % 1000 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon
      FROM supplier"""


BURST = """(SELECT * REPLACE (CASE WHEN user_id % 10 <> 0 THEN TIMESTAMP '2024-01-15 12:00:00'
  + to_microseconds((event_id * 7919) % 60000000) ELSE ts END AS ts) FROM events)"""


def shifted_sql(unit: str, n: int) -> str:
    """``fixtures.shifted_events``; ``unit`` is to_days or to_years."""
    return f"(SELECT * REPLACE (ts + {unit}(CAST({n} * (user_id % 3) AS INTEGER)) AS ts) FROM events)"


def daily_sql(headers: list[list[str]]) -> str:
    """The lines of ``fixtures.write_daily_csv``: all_lines, and lines of the
    files that have every column, with the reason why a line gives no row."""
    text = {
        "MMSI": "CASE WHEN k = 29 THEN 'x' || MMSI WHEN event_id % 5 = 0 THEN MMSI || '.0' ELSE CAST(MMSI AS VARCHAR) END",
        "BaseDateTime": "CASE WHEN k = 21 THEN 'noon' ELSE strftime(BaseDateTime, '%Y-%m-%dT%H:%M:%S.%f') END",
        "LAT": "CAST(CAST(LAT AS DECIMAL(9, 2)) AS VARCHAR)", "LON": "CAST(CAST(LON AS DECIMAL(9, 2)) AS VARCHAR)",
        "SOG": "CAST(CAST(SOG AS DECIMAL(18, 6)) AS VARCHAR)", "VesselType": "CAST(VesselType AS VARCHAR)",
        "Heading": "'511'", "IMO": "'IMO' || MMSI", "Status": "'5'"}
    row = lambda names: "concat_ws(',', " + ", ".join(text[n] for n in names) + ")"
    lines = "\n".join(f"WHEN {v} THEN CASE k WHEN 7 THEN {row(h)} || ',surplus' WHEN 13 THEN {row(h[:3])} ELSE {row(h)} END"
                      for v, h in enumerate(headers))
    ais = ais_sql().replace("SELECT CAST(", "SELECT event_id, CAST(", 1)
    return f"""
    WITH ais AS (
      SELECT *, event_id % 40 AS k, CAST(BaseDateTime AS DATE) AS day, dayofyear(BaseDateTime) % {len(headers)} AS variant,
        strftime(BaseDateTime, 'AIS_%Y_%m_%d.csv') AS file FROM ({ais}) a),
    all_lines AS (SELECT *, CASE variant {lines} END AS line FROM ais),
    lines AS (
      SELECT *, CASE WHEN k IN (7, 13) THEN 'does not fit the header' WHEN k = 29 THEN 'no vessel'
        WHEN k = 21 THEN 'no time' END AS reason
      FROM all_lines WHERE variant < {len(headers) - 1})"""


def ais_sql(type_rule: str = "freight", vessel: str = "user", nulls: bool = False, events: str = "events") -> str:
    vt = "70 + user_id % 20" if type_rule == "freight" else "60 + user_id % 40"
    mmsi = {"user": "user_id", "user_day": "user_id * 1000 + dayofyear(ts)", "one": "1"}[vessel]
    if nulls:
        return f"""
    SELECT MMSI, BaseDateTime, CASE WHEN NOT lost THEN LAT END AS LAT, CASE WHEN NOT lost THEN LON END AS LON,
      CASE WHEN event_id % 11 <> 5 THEN SOG END AS SOG, VesselType
    FROM (SELECT a.*, e.event_id, e.user_id % 10 = 3 AND day(e.ts) % 3 = 0 AS lost
          FROM ({ais_sql(type_rule, vessel).replace("SELECT CAST(", "SELECT event_id AS eid, CAST(", 1)}) a
          JOIN events e ON a.eid = e.event_id)"""
    return f"""
    SELECT CAST({mmsi} AS BIGINT) AS MMSI, ts AS BaseDateTime,
      CAST(2600 + 200 * (pk // 5) + CASE WHEN slow0 THEN 6 * (event_id % 5) ELSE 30 + event_id % 50 END
           AS DOUBLE) / CAST(100 AS DOUBLE) AS LAT,
      CAST(-9400 + 200 * (pk % 5) + CASE WHEN slow0 THEN 0 ELSE 2 * (event_id % 60) END
           AS DOUBLE) / CAST(100 AS DOUBLE) AS LON,
      CASE WHEN slow0 THEN {_d(0.1)} ELSE value / CAST(10 AS DOUBLE) END AS SOG,
      CAST({vt} AS INTEGER) AS VesselType
    FROM (SELECT *, value < 60 AS slow0, (user_id + day(ts) // 3) % 25 AS pk FROM {events} s) e"""


def chain(p: Params = DEFAULT, type_rule: str = "freight", vessel: str = "user", nulls: bool = False,
          inside: str = BOX, ports: str = NATION_PORTS, events: str = "events") -> str:
    """CTEs from events to routes; each query selects from one of them."""
    per = "CAST(year(BaseDateTime) AS INTEGER)" if p.period == "year" else \
        "CAST(year(BaseDateTime) * 100 + month(BaseDateTime) AS INTEGER)"
    w = "PARTITION BY period, MMSI ORDER BY seq"
    min_us = int(round(p.min_stop_hours * 3_600_000_000))
    gap_us = int(round(p.merge_gap_hours * 3_600_000_000))
    hour = _d(3_600_000_000.0)
    ang = lambda la1, lo1, la2, lo2: (  # noqa: E731  great-circle angle, radians
        f"2 * asin(sqrt(pow(sin((radians({la2}) - radians({la1})) / 2), 2) + cos(radians({la1})) * "
        f"cos(radians({la2})) * pow(sin((radians({lo2}) - radians({lo1})) / 2), 2)))")
    ra_c, ra_t = _d(p.aux_rate(False)), _d(p.aux_rate(True))
    rm_c, rm_t = _d(p.main_rate(False)), _d(p.main_rate(True))
    return f"""
    ais AS ({ais_sql(type_rule, vessel, nulls, events)}),
    typed AS (
      SELECT {per} AS period, CAST(year(BaseDateTime) AS INTEGER) AS year, *
      FROM ais
      WHERE VesselType BETWEEN {p.vessel_type_min} AND {p.vessel_type_max}
        AND MMSI IS NOT NULL AND BaseDateTime IS NOT NULL),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY period, MMSI
                                   ORDER BY BaseDateTime, LAT, LON, SOG, VesselType) AS seq,
             count(*) OVER (PARTITION BY period, MMSI) AS n_rows
      FROM typed),
    smoothed AS (
      SELECT period, year, MMSI, BaseDateTime, VesselType, seq, n_rows,
        CASE WHEN n_rows > 3 THEN median(LAT) OVER w3 ELSE LAT END AS LAT,
        CASE WHEN n_rows > 3 THEN median(LON) OVER w3 ELSE LON END AS LON,
        CASE WHEN n_rows > 3 THEN median(SOG) OVER w3 ELSE SOG END AS SOG,
        first_value(VesselType) OVER ({w}) AS first_type
      FROM numbered
      WINDOW w3 AS ({w} ROWS BETWEEN {p.smooth_window // 2} PRECEDING
                             AND {p.smooth_window - 1 - p.smooth_window // 2} FOLLOWING)),
    slowed AS (
      SELECT *, coalesce(SOG < {_d(p.slow_sog)}, false) AS slow FROM smoothed),
    changed AS (
      SELECT *, CASE WHEN slow <> coalesce(lag(slow) OVER ({w}), false) THEN 1 ELSE 0 END AS chg
      FROM slowed),
    grouped AS (
      SELECT *, sum(chg) OVER ({w} ROWS UNBOUNDED PRECEDING) AS grp FROM changed),
    runs AS (
      SELECT period, MMSI, grp, min(seq) AS s_seq, max(seq) AS e_seq,
             min(BaseDateTime) AS start_time, max(BaseDateTime) AS end_time, count(*) AS n_rows,
             epoch_us(max(BaseDateTime)) - epoch_us(min(BaseDateTime)) AS us,
             epoch_us(max(BaseDateTime)) - epoch_us(min(BaseDateTime)) >= {min_us} AS qualified
      FROM grouped WHERE slow GROUP BY period, MMSI, grp),
    qruns AS (
      SELECT *, CASE WHEN lag(end_time) OVER wq IS NULL
                       OR epoch_us(start_time) - epoch_us(lag(end_time) OVER wq) >= {gap_us}
                     THEN 1 ELSE 0 END AS new_stop
      FROM runs WHERE qualified
      WINDOW wq AS (PARTITION BY period, MMSI ORDER BY s_seq)),
    qids AS (
      SELECT *, sum(new_stop) OVER (PARTITION BY period, MMSI ORDER BY s_seq ROWS UNBOUNDED PRECEDING) AS stop_id
      FROM qruns),
    stops AS (
      SELECT period, MMSI, stop_id, min(s_seq) AS ss, max(e_seq) AS es,
             min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS n_runs
      FROM qids GROUP BY period, MMSI, stop_id),
    labelled AS (
      SELECT r.*, st.ss IS NOT NULL AS in_stop,
             CASE WHEN r.seq = st.ss OR r.seq = st.es THEN '1' ELSE '0' END AS Label
      FROM slowed r LEFT JOIN stops st
        ON r.period = st.period AND r.MMSI = st.MMSI AND r.seq BETWEEN st.ss AND st.es),
    kept AS (
      SELECT * FROM labelled WHERE NOT in_stop OR Label = '1'),
    legs AS (
      SELECT *, lag(BaseDateTime) OVER ({w}) AS prev_time,
             lead(LAT) OVER ({w}) AS next_LAT, lead(LON) OVER ({w}) AS next_LON,
             lead(SOG) OVER ({w}) AS next_SOG
      FROM kept),
    legs2 AS (
      SELECT *,
        coalesce(CAST(epoch_us(BaseDateTime) - epoch_us(prev_time) AS DOUBLE) / {hour}, {_d(0.0)}) AS TimeDiff,
        coalesce({ang('LAT', 'LON', 'next_LAT', 'next_LON')} * {_d(p.earth_radius_nm)}, {_d(0.0)}) AS distance_nm,
        coalesce(nullif((SOG + next_SOG) / 2, {_d(0.0)}), {_d(p.floor_speed)}) AS speed_mean,
        first_type BETWEEN {p.tanker_type_min} AND {p.tanker_type_max} AS tanker
      FROM legs),
    co2 AS (
      SELECT *, coalesce(CASE WHEN Label = '1'
          THEN (TimeDiff * CASE WHEN tanker THEN {ra_t} ELSE {ra_c} END) * {_d(p.co2_factor)}
          ELSE (CASE WHEN tanker THEN {rm_t} ELSE {rm_c} END * (distance_nm / speed_mean)) * {_d(p.co2_factor)}
          END, {_d(0.0)}) AS CO2
      FROM legs2),
    rejected AS (
      SELECT DISTINCT period, MMSI FROM co2 WHERE Label = '1' AND (LAT IS NULL OR LON IS NULL)),
    accepted AS (
      SELECT c.* FROM co2 c ANTI JOIN rejected r ON c.period = r.period AND c.MMSI = r.MMSI),
    boxes AS (
      SELECT n_nationkey AS ordinal, n_name AS name,
             CAST(-95 + 2 * (n_nationkey % 5) AS DOUBLE) AS x0, CAST(25 + 2 * (n_nationkey // 5) AS DOUBLE) AS y0
      FROM nation),
    ports AS ({ports}),
    poly AS (
      SELECT a.period, a.MMSI, a.seq, arg_min(b.name, b.ordinal) AS poly_state
      FROM accepted a JOIN boxes b
        ON {inside}
      GROUP BY a.period, a.MMSI, a.seq),
    cand AS (
      SELECT a.period, a.MMSI, a.seq, q.name, q.state, q.ordinal,
             {ang('a.LAT', 'a.LON', 'q.lat', 'q.lon')} AS d
      FROM accepted a, ports q
      WHERE a.Label = '1' AND {ang('a.LAT', 'a.LON', 'q.lat', 'q.lon')} <= radians({_d(p.port_radius_deg)})),
    nearest AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, MMSI, seq ORDER BY d, ordinal) AS rk
                     FROM cand) WHERE rk = 1),
    traj AS (
      SELECT a.*, pl.poly_state, n.name AS PortName, coalesce(n.state, pl.poly_state) AS State
      FROM accepted a
      LEFT JOIN poly pl ON a.period = pl.period AND a.MMSI = pl.MMSI AND a.seq = pl.seq
      LEFT JOIN nearest n ON a.period = n.period AND a.MMSI = n.MMSI AND a.seq = n.seq),
    ported AS (
      SELECT *, Label = '1' AND PortName IS NOT NULL AS at_port FROM traj),
    staying AS (
      SELECT *, at_port AND NOT coalesce(lag(at_port) OVER ({w}), false) AS stay_start FROM ported),
    starts AS (
      SELECT period, MMSI, year, seq, BaseDateTime AS start_time, PortName AS port, State AS state,
             row_number() OVER (PARTITION BY period, MMSI ORDER BY seq) AS k
      FROM staying WHERE stay_start),
    pairs AS (
      SELECT a.period, a.MMSI, a.year, a.seq AS s_seq, b.seq AS e_seq, a.start_time, b.start_time AS end_time,
             a.port AS start_port, a.state AS start_state, b.port AS end_port, b.state AS end_state
      FROM starts a JOIN starts b ON a.period = b.period AND a.MMSI = b.MMSI AND b.k = a.k + 1),
    route_rows AS (
      SELECT pr.*, t.State AS row_state, t.CO2 AS row_co2, t.seq AS row_seq
      FROM pairs pr JOIN staying t
        ON t.period = pr.period AND t.MMSI = pr.MMSI AND t.seq BETWEEN pr.s_seq AND pr.e_seq
      WHERE pr.start_state IS NOT NULL AND pr.end_state IS NOT NULL),
    routes AS (
      SELECT period, MMSI, year, start_time, end_time, start_port, start_state, end_port, end_state,
             sum(row_co2) AS total_emissions
      FROM route_rows
      GROUP BY period, MMSI, year, start_time, end_time, start_port, start_state, end_port, end_state),
    transit AS (
      SELECT period, MMSI, year, start_time, start_state, end_state, row_state AS state,
             sum(row_co2) AS emissions
      FROM route_rows
      WHERE row_state IS NOT NULL AND row_state <> start_state AND row_state <> end_state
      GROUP BY period, MMSI, year, start_time, start_state, end_state, row_state
      HAVING sum(row_co2) > 0),
    flows AS (
      SELECT period, MMSI, year, start_time, start_state AS source_state, state AS dest_state,
             emissions / 2.0 AS amount FROM transit
      UNION ALL
      SELECT period, MMSI, year, start_time, end_state AS source_state, state AS dest_state,
             emissions / 2.0 AS amount FROM transit),
    transfers AS (
      SELECT year, source_state, dest_state, sum(amount) AS amount
      FROM flows GROUP BY year, source_state, dest_state)
    """


def with_chain(select: str, p: Params = DEFAULT, **kw) -> str:
    return f"WITH {chain(p, **kw)}\n{select}"


def calendar_sql() -> str:
    return """
    WITH years AS (SELECT DISTINCT CAST(year(ts) AS INTEGER) AS year FROM events),
    cal AS (
      SELECT y.year, CAST(d AS DATE) AS day
      FROM years y, generate_series(make_date(y.year, 1, 1), make_date(y.year, 12, 31), INTERVAL 1 DAY) g(d)),
    named AS (SELECT year, day, 'AIS_' || strftime(day, '%Y_%m_%d') AS file_stem FROM cal)"""
