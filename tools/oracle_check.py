"""Local stand-in for the correctness gate: run each catalogue key on Spark
and its oracle SQL on DuckDB over the same parquet tables, then compare row
count, column names and an order-insensitive value hash.

usage: python tools/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from verdict.session import TABLES, build_session  # noqa: E402
from verdict.plans.registry import all_queries  # noqa: E402


def norm_value(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item"):
        return norm_value(v.item())
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm_value(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    keys = [a for a in args if not os.path.isdir(a)]
    spark = build_session("local[8]", shuffle_partitions=8, driver_memory="16g")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs = all_queries()
    bad = 0
    for name, q in qs.items():
        if keys and name not in keys:
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            rel = con.execute(q.sql)
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        td = time.time() - t1
        ok_cols = sorted(scols) == sorted(dcols)
        hs, ls = digest(srows, scols)
        hd, ld = digest(drows, dcols)
        status = "OK  " if ok_cols and len(srows) == len(drows) and hs == hd else "DIFF"
        if status != "OK  ":
            bad += 1
        print(f"{status} {name}: rows {len(srows)}/{len(drows)} cols_ok={ok_cols} "
              f"spark {ts:.1f}s duck {td:.1f}s")
        if status != "OK  ":
            if not ok_cols:
                print("   spark cols", scols, "\n   duck cols ", dcols)
            sd, dd = set(ls), set(ld)
            for x in list(sd - dd)[:4]:
                print("   spark only:", x[:300])
            for x in list(dd - sd)[:4]:
                print("   duck only: ", x[:300])
    print(f"done, {bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
