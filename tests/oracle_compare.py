"""Run registered Spark queries next to their DuckDB oracle and compare results.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cuefind.sources.testdata import TABLES  # noqa: E402


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _canon(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return _canon(v.asDict())
    return v


def canon_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from cuefind.plans.catalog import ORACLE, QUERIES
    con = con or duck_connect(sf_dir)
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_rows = sdf.collect()
    s_cols = sdf.columns
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if name not in ORACLE:
        res["oracle"] = None
        return res
    cur = con.execute(ORACLE[name])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    res["duck_rows"] = len(d_rows)
    res["duck_sec"] = round(time.time() - t1, 2)
    res["cols_match"] = sorted(s_cols) == sorted(d_cols)
    a, b = canon_rows(s_cols, s_rows), canon_rows(d_cols, d_rows)
    res["match"] = res["cols_match"] and a == b
    if not res["match"]:
        res["spark_cols"], res["duck_cols"] = s_cols, d_cols
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        res["only_spark"], res["only_duck"] = diff_a, diff_b
    return res


def main(argv):
    from cuefind.plans.catalog import QUERIES
    from cuefind.session import local_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(QUERIES)
    spark = local_session()
    con = duck_connect(sf_dir)
    ok = True
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:2000]}
        ok &= bool(r.get("match", r.get("oracle", 1) is None and "error" not in r))
        print(r, flush=True)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
