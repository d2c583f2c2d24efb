"""Runs registered queries and their SQL side by side: ``python tests/oracle_check.py FOLDER [name part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float) and not math.isnan(v):
        return round(v, 9)
    return v


# DuckDB type of each Spark type that the queries return.
TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_cell(r[i]) for i in order)) for r in rows), sorted(names)


def compare(spark, con, name, folder):
    """None when the query agrees with its SQL, else what differs. Also the number of rows and seconds."""
    from gleanframe.queries import ORACLE, QUERIES

    start = time.time()
    df = QUERIES[name](spark, folder)
    got, got_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if name not in ORACLE:
        return None if got else "no rows", len(got), seconds
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    want, want_names = rows_of(names, result.fetchall())
    types = {d[0]: str(d[1]) for d in result.description}
    wrong = {c: (t, types.get(c)) for c, t in df.dtypes if TYPES.get(t) != types.get(c)}
    if wrong:
        return f"types {wrong}", len(got), seconds
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got), seconds
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} vs {len(want)} rows; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}", len(got), seconds
    return None, len(got), seconds


def main():
    from pyspark.sql import SparkSession

    from gleanframe.queries import ORACLE, QUERIES

    folder, parts = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        try:
            problem, n, seconds = compare(spark, con, name, folder)
        except Exception as e:  # report and go on with the next query
            problem, n, seconds = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0.0
        bad += problem is not None
        kind = "sql" if name in ORACLE else "rows only"
        print(f"{'ok ' if problem is None else 'BAD'} {name:32} {n:7} rows {seconds:6.2f}s {kind} {problem or ''}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
