"""Run every query and its SQL side by side: ``python -m suite.check [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import threading
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from suite.queries import ORACLES, QUERIES

SQL_SECONDS = 120
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in NAMES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> tuple[str, int, float, float]:
    """Verdict, row count, seconds in Spark and in DuckDB."""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(cell(row[c]) for c in columns) for row in df.collect())
    middle = time.time()
    rows = sum(got.values())
    if name not in ORACLES:
        return ("rows only" if rows else "EMPTY"), rows, middle - start, 0.0
    timer = threading.Timer(SQL_SECONDS, con.interrupt)
    timer.start()
    try:
        relation = con.execute(ORACLES[name])
        names, expected = [d[0] for d in relation.description], relation.fetchall()
    finally:
        timer.cancel()
    if sorted(names) != columns:
        return f"COLUMNS {columns} {sorted(names)}", rows, middle - start, 0.0
    places = [names.index(c) for c in columns]
    want = Counter(tuple(cell(row[i]) for i in places) for row in expected)
    verdict = "ok"
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        verdict = f"DIFF got {rows} want {sum(want.values())} extra {str(extra)[:300]} missing {str(missing)[:300]}"
    return verdict, rows, middle - start, time.time() - middle


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        try:
            verdict, rows, spark_s, duck_s = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict, rows, spark_s, duck_s = f"ERROR {type(error).__name__} {str(error)[:250]}", 0, 0.0, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:28s} {rows:8d} spark {spark_s:6.2f} duckdb {duck_s:6.2f}  {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
