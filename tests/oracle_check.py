"""Run registered queries against their DuckDB oracles (like the driver's check).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    return repr(v) if v is not None else "NULL"


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.sql(sql)
    dcols = res.columns
    drows = res.fetchall()
    t2 = time.time()
    hs, ls = digest(scols, srows)
    hd, ld = digest(dcols, drows)
    ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
    info = f"{name:20s} {'OK ' if ok else 'BAD'} rows {len(srows)}/{len(drows)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if not ok:
        info += f"\n   cols spark={scols} duck={dcols}"
        diff_s = sorted(set(ls) - set(ld))[:3]
        diff_d = sorted(set(ld) - set(ls))[:3]
        info += f"\n   spark-only {diff_s}\n   duck-only  {diff_d}"
    return ok, info


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from keelson.session import get_spark
    spark = get_spark("local[8]", 8)
    qs, ors = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in ors:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"{name:20s} --- rows {n} (no oracle) {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            ok, info = compare(spark, con, name, fn, ors[name], sf_dir)
        except Exception as e:  # report and continue
            ok, info = False, f"{name:20s} ERR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(info, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
