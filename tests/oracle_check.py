"""Run queries and their SQL side by side: python tests/oracle_check.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """Values in a comparable form: strict on type, doubles by their repr."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, run, sql):
    """(rows, problem or None)."""
    df = run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    rel = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return len(got), f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return len(got), f"{len(got)} rows vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return len(got), f"{len(bad)} rows differ, first:\n   {bad[0][0]}\n   {bad[0][1]}"
    return len(got), None


def main() -> int:
    import __spark_entry__ as entry
    from winledger.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            n, problem = compare(spark, con, sf_dir, run, sqls.get(name))
        except Exception as exc:
            n, problem = -1, f"{type(exc).__name__}: {str(exc)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        mark = "ok  " if problem is None else "FAIL"
        if problem is None and sqls.get(name) is None:
            mark = "rows"
        print(f"{mark} {name} n={n} {time.time() - t0:.1f}s {problem or ''}", flush=True)
        failed += problem is not None
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
