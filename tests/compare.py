"""Run registered queries next to their SQL and compare the rows; also usable from the command line.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb
import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    """A comparable form: numbers as floats rounded a little, arrays as tuples, nulls as text."""
    if value is None:
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, np.number)) or type(value).__name__ == "Decimal":
        value = float(value)
        return "nan" if math.isnan(value) else f"{value + 0.0:.5g}" if abs(value) < 1e-3 else f"{value:.9g}"
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, folder):
    """Times and a list of differences."""
    start = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    spark_time = time.time() - start
    if sql is None:
        return spark_time, None, len(got), [] if got else ["no rows"]
    start = time.time()
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    wanted = cursor.fetchall()
    sql_time = time.time() - start
    got_columns, got_rows = rows_of(df.columns, got)
    columns, wanted_rows = rows_of(columns, wanted)
    problems = []
    if got_columns != columns:
        problems.append(f"columns {got_columns} != {columns}")
    elif got_rows != wanted_rows:
        extra, missing = set(got_rows) - set(wanted_rows), set(wanted_rows) - set(got_rows)
        problems.append(
            f"rows {len(got_rows)} vs {len(wanted_rows)}; only spark {len(extra)}: {sorted(extra)[:3]}; "
            f"only sql {len(missing)}: {sorted(missing)[:3]}"
        )
    if not got_rows:
        problems.append("no rows")
    return spark_time, sql_time, len(got), problems


if __name__ == "__main__":
    import __spark_entry__ as e

    args = sys.argv[1:]
    where = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    s, c = session(), database(where)
    sqls = e.oracle_sql()
    bad = []
    for n, q in e.queries().items():
        if args and n not in args:
            continue
        try:
            t, o, count, trouble = compare(s, c, n, q, sqls.get(n), where)
            state = "ok  " if not trouble else "FAIL"
            print(f"{state} {n:28s} {t:6.1f}s sql {o if o is None else round(o, 1)} rows {count}", flush=True)
        except Exception as error:  # noqa: BLE001
            trouble = [f"{type(error).__name__}: {str(error)[:1500]}"]
            print(f"ERR  {n}", flush=True)
        for line in trouble:
            print("     ", line[:1800], flush=True)
            bad.append(n)
    print("bad:", sorted(set(bad)))
