"""Run registered queries against their DuckDB oracles (like the driver).

    python tests/oracle_check.py [sf_dir] [name ...]
"""
from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, Decimal):
        return str(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, os_ = E.queries(), E.oracle_sql()
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            got_cols = df.columns
            got = rows_of(got_cols, [tuple(r) for r in df.collect()])
        except Exception as exc:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}"
            print(name, results[name], flush=True)
            continue
        dt = time.time() - t0
        if name not in os_:
            results[name] = f"no oracle ({len(got)} rows)"
            print(name, results[name], flush=True)
            continue
        try:
            cur = con.execute(os_[name])
            exp_cols = [d[0] for d in cur.description]
            exp = rows_of(exp_cols, cur.fetchall())
        except Exception as exc:  # noqa: BLE001
            results[name] = f"ORACLE ERROR {type(exc).__name__}: {str(exc)[:300]}"
            print(name, results[name], flush=True)
            continue
        ok_cols = sorted(got_cols) == sorted(exp_cols)
        ok = ok_cols and got == exp
        results[name] = "OK" if ok else "MISMATCH"
        if verbose:
            print(f"{name}: {results[name]} rows spark={len(got)} oracle={len(exp)} "
                  f"{dt:.1f}s", flush=True)
            if not ok_cols:
                print("   cols", sorted(got_cols), sorted(exp_cols))
            elif not ok:
                diff_a = [r for r in got if r not in set(exp)][:3]
                diff_b = [r for r in exp if r not in set(got)][:3]
                print("   spark-only", diff_a)
                print("   oracle-only", diff_b)
    return results


if __name__ == "__main__":
    from ledgerline.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]")
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v != "OK"}
    print("SUMMARY", len(res) - len(bad), "ok of", len(res), bad)
