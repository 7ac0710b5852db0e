"""Run registered queries next to their SQL in DuckDB and compare all values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (list, tuple)):
        return repr([norm(x) for x in v])
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    t0 = time.time()
    df = fn(spark, folder)
    cols, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return len(rows), took, None, 0.0
    t1 = time.time()
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    sql_took = time.time() - t1
    if cols != want_cols:
        return len(rows), took, f"columns {cols} != {want_cols}", sql_took
    if len(rows) != len(want):
        return len(rows), took, f"rows {len(rows)} != {len(want)}", sql_took
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x[:200], y[:200]) for c, x, y in zip(cols, a, b) if x != y]
        return len(rows), took, f"{len(bad)} rows differ, e.g. {diff[:3]}", sql_took
    return len(rows), took, None, sql_took


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from rostrum.session import build_session

    if os.environ.get("LONG_KEYS"):
        # Treat every key as long and cut it into tiny blocks.
        from rostrum.operators import tree
        from rostrum.plans import ordered

        ordered.LONG_KEY_ROWS, ordered.BLOCK_ROWS, tree.LOCAL_NODE_ROWS = 10, 8, 12
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(folder), entry.oracle_sql()
    wanted = sys.argv[1:]
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            n, took, bad, sql_took = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as e:  # report and go on
            n, took, bad, sql_took = -1, 0.0, f"{type(e).__name__}: {str(e)[:1500]}", 0.0
        failed += bad is not None
        mark = "FAIL" if bad else ("ok" if name in sqls else "ok (rows only)")
        print(f"{name:38s} {n:7d} rows {took:6.2f}s sql {sql_took:5.2f}s {mark} {bad or ''}", flush=True)
    print("failed:", failed)
