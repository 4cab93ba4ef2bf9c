"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        f = float(v)
        return str(int(f)) if f == int(f) and abs(f) < 1e15 else repr(f + 0.0)
    return str(v)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted(tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False))


def compare(spark, con, name: str, build, sql: str | None, folder: str) -> tuple[str, int, float]:
    t = time.time()
    got = build(spark, folder).toPandas()
    took = time.time() - t
    if sql is None:
        return "rows", len(got), took
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} / {sorted(want.columns)}", len(got), took
    a, b = rows(got), rows(want)
    if a == b:
        kinds = {c for c in got.columns if pd.api.types.is_float_dtype(got[c]) != pd.api.types.is_float_dtype(want[c])
                 and not got[c].isna().any() and len(got)}
        return ("ok" if not kinds else f"TYPES {kinds}"), len(got), took
    if len(a) != len(b):
        return f"ROWS {len(a)} / {len(b)}", len(got), took
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"VALUES {len(bad)} differ, first {bad[0]} cols {sorted(got.columns)}", len(got), took


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tendersift.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session("8"), connect(folder)
    sqls, only = entry.oracle_sql(), sys.argv[1:]
    for name, build in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            verdict, n, took = compare(spark, con, name, build, sqls.get(name), folder)
        except Exception as e:  # show and go on with the next query
            verdict, n, took = f"ERROR {type(e).__name__}: {str(e)[:600]}", -1, 0.0
        print(f"{name:36s} {n:8d} {took:6.2f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
