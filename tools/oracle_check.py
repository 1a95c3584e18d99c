"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, status, rows (spark/duckdb), seconds.
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from kasaflow.session import get_or_create_session  # noqa: E402
from kasaflow.plans.catalog import queries  # noqa: E402
from kasaflow.plans.oracle import oracle_sql  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v, digits=9):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.{digits}g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.{digits}g}")
    if isinstance(v, (datetime, date)):
        return v.isoformat()[:10] if isinstance(v, date) and not isinstance(v, datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    return v


def rows_of(cols, records, order):
    idx = [cols.index(c) for c in order]
    out = [tuple(norm(r[i]) for i in idx) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_or_create_session(f"local[{os.environ.get('CPUS', '8')}]")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sq = queries(), oracle_sql()
    names = names or [n for n in qs if n != "pipeline" and not n.startswith("op")] + [n for n in qs if n in sq and n.startswith("op")]
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sq:
            print(f"{name:32s} rows-only  spark={len(srows)}  {ts:.1f}s")
            continue
        try:
            con.execute(f"CREATE OR REPLACE VIEW oracle_of_query AS {sq[name]}")  # as the driver does
            res = con.execute("SELECT * FROM oracle_of_query")
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SQL-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"{name:32s} COLS  spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        order = sorted(scols)
        a, b = rows_of(scols, srows, order), rows_of(dcols, drows, order)
        status = "OK" if a == b else "DIFF"
        if a != b:
            bad += 1
            diff_a = [r for r in a if r not in set(b)][:3]
            diff_b = [r for r in b if r not in set(a)][:3]
            print(f"{name:32s} DIFF spark={len(a)} duck={len(b)}\n   cols={order}\n   spark-only={diff_a}\n   duck-only={diff_b}")
            continue
        exact = rows_of(scols, [tuple(r) for r in srows], order) == a
        print(f"{name:32s} {status:5s} rows={len(a)}  {ts:.1f}s")
    print(f"FAILED {bad} of {len(names)}")


if __name__ == "__main__":
    main()
