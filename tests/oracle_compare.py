"""Run registered Spark queries and their DuckDB oracle side by side and compare (names, rows, values).

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from carepath.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, repr(v) if STRICT else f"{round(v, 6):.6f}")
    if isinstance(v, bool):
        return (3, str(v))
    return (3, str(v))


def normalized_rows(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return names, out


def compare(spark, sf_dir: str, name: str, query, sql: str, con=None) -> tuple[bool, str]:
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sn, sr = normalized_rows(s_cols, s_rows)
    dn, dr = normalized_rows(d_cols, d_rows)
    if sn != dn:
        return False, f"{name}: columns differ spark={sn} duck={dn}"
    if len(sr) != len(dr):
        return False, f"{name}: rows differ spark={len(sr)} duck={len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return False, f"{name}: {len(bad)} value rows differ, first spark={bad[0][0]} duck={bad[0][1]}"
    return True, f"{name}: ok {len(sr)} rows, spark {t1 - t0:.1f}s"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from carepath.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(oracle_sql())
    if os.environ.get("ORACLE_DEFAULT_SESSION") == "1":  # a plain session with Spark's defaults
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session()
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    failed = 0
    for n in names:
        try:
            ok, msg = compare(spark, sf_dir, n, qs[n], sqls[n], con)
        except Exception as exc:  # report and continue
            ok, msg = False, f"{n}: error {type(exc).__name__}: {str(exc)[:400]}"
        failed += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - failed}/{len(names)} passed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
