"""Run registered queries against their SQL twins: python tests/check_catalog.py [sf_dir] [name ...]"""

import math
import os
import signal
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
from tabspark.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"{len(rows)} rows (no SQL)", took
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(rel.columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(rel.columns)}", took
    ints = {"bigint", "int"}
    kinds = dict(df.dtypes)
    for c, t in zip(rel.columns, map(str, rel.types)):
        mine = kinds[c]
        if ("DOUBLE" == t) != (mine == "double") and t != "NULL" and '"NULL"' not in t and t != "INTEGER":
            return False, f"type of {c}: {mine} != {t}", took
        if mine in ints and t not in ("BIGINT", "INTEGER", "HUGEINT"):
            return False, f"type of {c}: {mine} != {t}", took
    a, b = canonical(rows, df.columns), canonical(want, rel.columns)
    if a == b:
        return True, f"{len(a)} rows", took
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"{len(a)} vs {len(b)} rows, {sum(x != y for x, y in zip(a, b))} differ, e.g. {diff}", took


LIMIT = int(os.environ.get("QUERY_SECONDS", "90"))


def main():
    def stop(*_):
        raise TimeoutError(f"over {LIMIT} seconds")

    signal.signal(signal.SIGALRM, stop)
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    bad = []
    for name in args or queries:
        signal.alarm(LIMIT)
        try:
            ok, note, took = compare(spark, sf_dir, name, queries[name], sql.get(name))
        except Exception as e:  # report and go on
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:300]}", 0.0
        signal.alarm(0)
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.1f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
