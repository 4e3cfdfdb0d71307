"""Run registered queries against their DuckDB oracle and compare results.

Usable from pytest (``compare_query``) and from the command line::

    python tests/oracle_harness.py [name ...] [--sf /root/testdata/sf0.01]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v
    if isinstance(v, decimal.Decimal):
        return v.normalize() if v != 0 else decimal.Decimal(0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), str(x)) for x in row)


def compare_rows(spark_cols, spark_rows, duck_cols, duck_rows, rel_tol=1e-9):
    """Return (ok_exact, ok_tolerant, message)."""
    if sorted(spark_cols) != sorted(duck_cols):
        return False, False, f"columns differ: spark={spark_cols} duck={duck_cols}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    s = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=_key)
    d = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=_key)
    if len(s) != len(d):
        return False, False, f"row count spark={len(s)} duck={len(d)}"
    exact = s == d
    if exact:
        return True, True, f"{len(s)} rows equal"
    bad = 0
    first = None
    for a, b in zip(s, d):
        for x, y in zip(a, b):
            same = x == y
            if not same and isinstance(x, float) and isinstance(y, float):
                same = math.isclose(x, y, rel_tol=rel_tol, abs_tol=1e-12)
            if not same:
                bad += 1
                if first is None:
                    first = (a, b)
                break
    if bad == 0:
        return False, True, f"{len(s)} rows equal within float tolerance"
    return False, False, f"{bad} rows differ; first: spark={first[0]} duck={first[1]}"


def compare_query(spark, name: str, sf_dir: str, con=None):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    spark_cols = df.columns
    spark_rows = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        return None, None, f"{len(spark_rows)} rows (no oracle)"
    con = con or duck_connection(sf_dir)
    res = con.execute(sql)
    duck_cols = [c[0] for c in res.description]
    duck_rows = res.fetchall()
    return compare_rows(spark_cols, spark_rows, duck_cols, duck_rows)


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args(argv)
    from ledgerlens.session import build_session
    from __spark_entry__ import queries

    spark = build_session("local[8]", 8)
    con = duck_connection(args.sf)
    names = args.names or list(queries())
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            exact, tol, msg = compare_query(spark, name, args.sf, con)
        except Exception as exc:  # report and continue
            exact, tol, msg = False, False, f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        status = "EXACT" if exact else ("CLOSE" if tol else ("NO-ORACLE" if tol is None and exact is None else "FAIL"))
        if status == "FAIL":
            failed += 1
        print(f"{status:9s} {name:28s} {time.time() - t0:6.2f}s  {msg}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
