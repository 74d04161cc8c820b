"""Runs registered queries beside their SQL.  python tests/oracle.py SF_DIR [NAME...] prints what differs."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compared(spark, sf_dir, run, sql):
    df = run(spark, sf_dir)
    own = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f + ('/*.parquet' if os.path.isdir(f) else '')}'")
    found = con.execute(sql)
    return own, rows_of([c[0] for c in found.description], found.fetchall())


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sql = entry.oracle_sql()
    for name in sys.argv[2:] or sql:
        t = time.time()
        try:
            (a, own), (b, want) = compared(spark, sys.argv[1], entry.queries()[name], sql[name])
            ok = a == b and own == want
            print("ok  " if ok else "DIFF", name, len(own), f"{time.time() - t:.1f}s", flush=True)
            if not ok:
                print("   ", a, b, len(want), [x for x in own if x not in want][:2], [x for x in want if x not in own][:2])
        except Exception as e:
            print("FAIL", name, str(e)[:600], flush=True)


if __name__ == "__main__":
    main()
