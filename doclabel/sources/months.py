"""Harvested records stored by month: date ranges read few files, new pages rewrite few months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclabel.sources.harvest import COLUMNS, FIRST_DAY, check_day, harvest_range, harvest_union
from doclabel.staging import stage

MONTH = "month"
UNDATED = "none"
SCHEMA = ", ".join(f"{c} string" for c in (*COLUMNS, MONTH))


def _month(date: str = "Date") -> Column:
    return F.when(F.length(date) >= 7, F.substring(date, 1, 7)).otherwise(UNDATED)


def write_months(records: DataFrame, path: str) -> None:
    """Write records below one folder per month; only months that have records here are replaced.

    Rows are brought together by month before writing, and a month with very many
    is split over several tasks and files.
    """
    rows = records.select(*COLUMNS, _month().alias(MONTH)).hint("rebalance", MONTH)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def read_months(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def add_pages(pages: DataFrame, path: str) -> list[str]:
    """Merge new pages into a store; a paper stays once, with its newest record. Returns the months rewritten.

    These are the months of the new records and those in which older records of
    the same papers lie, since a revision may move a paper to another month. All
    other months are neither read whole nor written.
    """
    spark = pages.sparkSession
    new = stage(pages.select(*COLUMNS), "pages")
    stored = read_months(spark, path)
    held = stored.select("arXiv_id", MONTH).join(new.select("arXiv_id"), "arXiv_id", "left_semi")
    touched = new.select(_month().alias(MONTH)).unionByName(held.select(MONTH)).distinct()
    months = sorted(r[MONTH] for r in touched.collect())  # months, not records
    before = stored.filter(F.col(MONTH).isin(months)).select(*COLUMNS)
    merged = stage(harvest_union(before.unionByName(new), latest="Date"), "merged")
    left = {r[MONTH] for r in merged.select(_month().alias(MONTH)).distinct().collect()}
    write_months(merged, path)
    for month in sorted(set(months) - left):  # all of its papers have moved
        folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"{MONTH}={month}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return months


def read_range(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Records with a date in [start, end]; folders of other months are not opened."""
    first, last = check_day(start or FIRST_DAY)[:7], check_day(end)[:7] if end else None
    inside = F.col(MONTH) >= first if last is None else F.col(MONTH).between(first, last)
    return harvest_range(read_months(spark, path).filter(inside & (F.col(MONTH) != UNDATED)), start, end).select(*COLUMNS)
