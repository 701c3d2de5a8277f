"""Run registered queries in Spark and their DuckDB oracles; compare results.

Mirrors the driver's check: row count, column names, order-insensitive values.
Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(round(v, 6)))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return (2, repr([_norm(x) for x in v]))
    if isinstance(v, dict):
        return (3, repr(sorted((k, _norm(x)) for k, x in v.items())))
    if hasattr(v, "asDict"):
        return (3, repr(sorted((k, _norm(x)) for k, x in v.asDict().items())))
    if isinstance(v, bool):
        return (4, str(v))
    if isinstance(v, int):
        return (1, repr(round(float(v), 6)))
    return (5, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, name: str, sf_dir: str, fn, sql: str | None):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, rows=len(srows), oracle=None, spark_s=round(t1 - t0, 2))
    con = duck(sf_dir)
    res = con.sql(sql)
    dcols = res.columns
    drows = res.fetchall()
    out = dict(name=name, rows=len(srows), oracle_rows=len(drows), spark_s=round(t1 - t0, 2))
    out["cols_ok"] = sorted(scols) == sorted(dcols)
    if not out["cols_ok"]:
        out["spark_cols"], out["duck_cols"] = scols, dcols
        out["ok"] = False
        return out
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    out["ok"] = a == b and len(srows) == len(drows)
    if not out["ok"]:
        sa, sb = set(a), set(b)
        out["only_spark"] = list(sa - sb)[:3]
        out["only_duck"] = list(sb - sa)[:3]
    return out


def main(argv):
    from mathtide.session import get_session
    import __spark_entry__ as entry
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    if os.environ.get("ORACLE_PLAIN_SESSION"):
        # a session like a bare driver's: default partitions, another time zone
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.sql.session.timeZone", "America/New_York").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_session("local[8]", shuffle_partitions=8)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        try:
            r = compare(spark, name, sf_dir, qs[name], sqls.get(name))
        except Exception as e:  # report and continue
            r = dict(name=name, ok=False, error=repr(e)[:2000])
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print("FAILED:", bad)


if __name__ == "__main__":
    main(sys.argv)
