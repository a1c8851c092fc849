"""Run registered queries in Spark and their SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and the multiset of rows (doubles
rounded to 6 places, timestamps as ISO text).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr), [cols[i] for i in order]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    a, acols = rows_of(df.columns, srows)
    b, bcols = rows_of(ocols, orows)
    ok = acols == bcols and a == b
    msg = f"{name:20s} {'OK ' if ok else 'BAD'} spark={len(a):6d} oracle={len(b):6d} {t1 - t0:6.2f}s"
    if not ok:
        if acols != bcols:
            msg += f"\n   cols spark={acols}\n   cols oracle={bcols}"
        else:
            sa, sb = set(a), set(b)
            msg += f"\n   only spark: {sorted(sa - sb, key=repr)[:3]}\n   only oracle: {sorted(sb - sa, key=repr)[:3]}"
    return ok, msg


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from vessel_flow.session import get_spark
    spark = get_spark("local[8]", 8)
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(q):
        if name not in o:
            n = q[name](spark, sf_dir).count()
            print(f"{name:20s} ROWS-ONLY {n}")
            continue
        try:
            ok, msg = compare(spark, con, name, q[name], o[name], sf_dir)
        except Exception as e:  # report and go on
            ok, msg = False, f"{name:20s} ERR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(msg, flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
