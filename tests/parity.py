"""Run a registered Spark query and its DuckDB oracle and compare results.

Order-insensitive: column names must match exactly; rows are compared as
sorted tuples with doubles rounded to 9 significant digits.

    python -m tests.parity [name ...]       # default: every oracle query, sf0.01
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


EXACT = False     # True: doubles must agree to the last bit


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v) if EXACT else float(f"{float(v):.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark, name: str, folder: str, con=None) -> dict:
    from __spark_entry__ import oracle_sql, queries
    con = con or duck(folder)
    t0 = time.time()
    sdf = queries()[name](spark, folder)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(oracle_sql()[name])
    d_cols = rel.columns
    d_rows = rel.fetchall()
    t2 = time.time()
    out = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_sec": round(t1 - t0, 2), "oracle_sec": round(t2 - t1, 2)}
    if sorted(s_cols) != sorted(d_cols):
        out["error"] = f"columns differ: spark {s_cols} oracle {d_cols}"
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_idx = [d_cols.index(s_cols[i]) for i in order]
    s_n = sorted((tuple(_norm(r[i]) for i in order) for r in s_rows), key=_key)
    d_n = sorted((tuple(_norm(r[i]) for i in d_idx) for r in d_rows), key=_key)
    if s_n != d_n:
        diff = [(a, b) for a, b in zip(s_n, d_n) if a != b][:3]
        out["error"] = f"values differ (cols {sorted(s_cols)}): {diff}"
    out["ok"] = "error" not in out
    return out


def main(argv):
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql
    from shopflow.session import build_session
    folder = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")] or sorted(oracle_sql())
    global EXACT
    for a in argv:
        if a.startswith("--sf="):
            folder = f"/root/testdata/sf{a[5:]}"
        if a == "--exact":
            EXACT = True
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(folder)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, folder, con)
        except Exception as e:  # report and go on
            r = {"name": n, "ok": False, "error": f"{type(e).__name__}: {str(e)[:800]}"}
        bad += not r.get("ok")
        print(("OK  " if r.get("ok") else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
