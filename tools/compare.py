"""Run registered queries in Spark and their oracles in DuckDB and compare the results.

    python tools/compare.py [--sf DIR] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def key(row):
    return tuple((x is None, str(type(x)) if isinstance(x, (str, tuple)) else "", f"{x:.6g}" if isinstance(x, float) else str(x)) for x in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: only spark {sorted(set(spark_cols)-set(duck_cols))}, only sql {sorted(set(duck_cols)-set(spark_cols))}"
    if len(spark_rows) != len(duck_rows):
        return f"rows differ: spark {len(spark_rows)}, sql {len(duck_rows)}"
    so = [spark_cols.index(c) for c in sorted(spark_cols)]
    do = [duck_cols.index(c) for c in sorted(duck_cols)]
    a = sorted((tuple(norm(r[i]) for i in so) for r in spark_rows), key=key)
    b = sorted((tuple(norm(r[i]) for i in do) for r in duck_rows), key=key)
    inexact = 0
    for x, y in zip(a, b):
        for c, p, q in zip(sorted(spark_cols), x, y):
            if p == q and type(p) is type(q):
                continue
            if isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9):
                inexact += 1
                continue
            return f"value differs in {c}: spark {p!r} sql {q!r}\n   spark {x}\n   sql   {y}"
    return f"ok, {inexact} cells equal only to 1e-9" if inexact else "ok"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--family")
    a = ap.parse_args()
    from gridtide.session import local_session
    import importlib

    from gridtide.workload import registry

    if a.family:
        for f in a.family.split(","):
            importlib.import_module(f"gridtide.workload.{f}")
        qs, os_ = dict(registry._QUERIES), dict(registry._ORACLES)
    else:
        qs, os_ = registry.queries(), registry.oracle_sql()
    spark = local_session()
    con = connect(a.sf)
    names = [n for n in qs if not a.names or any(n.startswith(p) for p in a.names)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, a.sf)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if n not in os_:
                print(f"{n:45s} {t1-t0:6.2f}s rows={len(rows)} no oracle", flush=True)
                continue
            cur = con.execute(os_[n])
            cols = [d[0] for d in cur.description]
            drows = cur.fetchall()
            res = compare(rows, df.columns, drows, cols)
            if not res.startswith("ok"):
                bad += 1
            print(f"{n:45s} {t1-t0:6.2f}s rows={len(rows)} {res}{'  EMPTY' if not rows else ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{n:45s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
