"""Run registered queries in Spark and their SQL oracle in DuckDB; compare.

Comparison: column names (sorted), row count, and the multiset of rows with
doubles rounded to 6 places. Usage: ``python -m tests.oracle_compare [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v) and abs(v) < 2**53:
            return round(v, 6)
        return round(v, 6)
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
    except Exception:
        pass
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, name: str, sf_dir: str, con=None, verbose=True):
    from ledgerlint.plans.oracles import oracle_sql
    from ledgerlint.plans.queries import queries
    con = con or duck(sf_dir)
    t0 = time.time()
    df = queries()[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return {"name": name, "ok": None, "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    ok_v = ok_cols and ok_n and _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
    out = {"name": name, "ok": bool(ok_cols and ok_n and ok_v), "cols": ok_cols, "rows": (len(s_rows), len(d_rows)),
           "values": ok_v, "spark_s": round(t1 - t0, 2)}
    if verbose and not out["ok"]:
        if not ok_cols:
            out["spark_cols"] = sorted(s_cols)
            out["duck_cols"] = sorted(d_cols)
        elif ok_n:
            a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            out["first_diffs"] = diff
            out["sorted_cols"] = sorted(s_cols)
    return out


def main(argv):
    from ledgerlint.plans.queries import queries
    from ledgerlint.session import get_spark
    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")] or list(queries())
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "error": repr(e)[:800]}
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print("FAILED", bad, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])
