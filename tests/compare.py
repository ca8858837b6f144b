"""Run registered queries on Spark and their SQL on DuckDB, and compare names, types and rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short text."""
    t0 = time.time()
    got = fn(spark, sf_dir).toArrow()
    t1 = time.time()
    want = con.sql(sql).to_arrow_table()
    times = f"spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s rows {got.num_rows}"
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}", times
    cols = sorted(got.column_names)
    simple = lambda t: str(t).replace("large_", "").replace("[us, tz=UTC]", "[us]")
    types = [(c, simple(got.schema.field(c).type), simple(want.schema.field(c).type)) for c in cols]
    bad = [t for t in types if t[1] != t[2]]
    if bad:
        return f"types {bad}", times
    rows = lambda t: sorted(tuple(map(_cell, r)) for r in zip(*[t.column(c).to_pylist() for c in cols]))
    a, b = rows(got), rows(want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return f"rows {len(a)} vs {len(b)}; {cols}\n  spark {only_a[:3]}\n  sql   {only_b[:3]}", times
    return None, times


def main(argv):
    from urlsieve.registry import ORACLES, QUERIES, load_all
    from urlsieve.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    load_all()
    spark = local_session(cpus="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = [n for n in QUERIES if not argv or any(n.startswith(a) for a in argv)]
    failed = []
    for n in names:
        try:
            if n in ORACLES:
                problem, times = compare(spark, con, QUERIES[n], ORACLES[n], sf_dir)
            else:
                t0 = time.time()
                rows = QUERIES[n](spark, sf_dir).toArrow().num_rows
                problem, times = None, f"rows only: {rows} in {time.time() - t0:.1f}s"
        except Exception as exc:  # noqa: BLE001
            problem, times = f"{type(exc).__name__}: {str(exc)[:1500]}", ""
        print(("ok   " if problem is None else "FAIL ") + n, times, problem or "", flush=True)
        if problem:
            failed.append(n)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
