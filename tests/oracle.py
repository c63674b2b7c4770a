"""Compare registered queries with their SQL twins in DuckDB: ``python tests/oracle.py sf_dir [name-part ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL" if v is None else "nan"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return f"{type(v).__name__}:{v}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return [cols[k] for k in order], sorted(tuple(_norm(r[k]) for k in order) for r in rows)


def compare(df, con, sql) -> tuple[str, int]:
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"rows {len(got)} != {len(want)} {only}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return (f"{len(bad)} of {len(got)} differ: {bad[:2]}" if bad else "ok"), len(got)


def main() -> None:
    import __spark_entry__ as entry
    from protspark.session import local_session

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    sql, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            if name in sql:
                verdict, n = compare(fn(spark, sf_dir), con, sql[name])
            else:
                verdict, n = "rows only", fn(spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        failed += verdict not in ("ok", "rows only")
        empty = " EMPTY" if n == 0 else ""
        print(f"{name:34s} {time.time() - t:6.2f}s {n:8d} {verdict}{empty}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
