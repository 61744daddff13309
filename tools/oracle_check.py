"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Mimics the driver's check: column names sorted, row count, and an
order-insensitive hash of the values.

    python tools/oracle_check.py [sf_dir] [key ...]
"""
from __future__ import annotations

import datetime as dt
import hashlib
import math
import sys
import time
from decimal import Decimal

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from timefuse.session import get_spark  # noqa: E402
from timefuse.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha1("\n".join(keyed).encode()).hexdigest(), keyed


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    import importlib
    entry = importlib.import_module("__spark_entry__")
    spark = get_spark("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for k in (keys or list(qs)):
        t0 = time.time()
        try:
            df = qs[k](spark, sf)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"ROWS {k}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(sqls[k])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        hs, ks = digest(scols, srows)
        hd, kd = digest(dcols, drows)
        if ok_cols and len(srows) == len(drows) and hs == hd:
            print(f"OK   {k}: {len(srows)} rows {ts:.1f}s")
        else:
            bad += 1
            print(f"FAIL {k}: cols_ok={ok_cols} spark={sorted(scols)} duck={sorted(dcols)} rows {len(srows)} vs {len(drows)}")
            sd, dd = set(ks), set(kd)
            for x in list(sd - dd)[:3]:
                print("   spark only:", x[:300])
            for x in list(dd - sd)[:3]:
                print("   duck  only:", x[:300])
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
