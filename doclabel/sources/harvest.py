"""Harvested metadata records (OAI-PMH pages) as a six-column table."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclabel.functions.codes import extract_codes, join_authors

# Record layout, columns and the default first day.
RECORD_TAG = "record"
RECORD_SCHEMA = (
    "header struct<datestamp: string>, "
    "metadata struct<arXiv: struct<id: string, title: string, "
    "authors: struct<author: array<struct<keyname: string, forenames: string>>>, "
    "`msc-class`: string, abstract: string>>"
)
COLUMNS = ("arXiv_id", "Title", "Authors", "Date", "MSCs", "Abstract")
FIRST_DAY = "2010-01-01"


def record_columns(records: DataFrame) -> DataFrame:
    """Flatten parsed records; a missing field becomes the empty string."""
    paper = F.col("metadata.arXiv")

    def text(column):
        return F.coalesce(column, F.lit(""))

    return records.select(
        text(paper["id"]).alias("arXiv_id"),
        text(paper["title"]).alias("Title"),
        join_authors(paper["authors"]["author"]).alias("Authors"),
        text(F.col("header.datestamp")).alias("Date"),
        extract_codes(paper["msc-class"]).alias("MSCs"),
        text(paper["abstract"]).alias("Abstract"),
    )


def _xml(reader):
    return (
        reader.format("xml").schema(RECORD_SCHEMA).option("rowTag", RECORD_TAG)
        .option("ignoreSurroundingSpaces", "false").option("mode", "FAILFAST")
    )


def read_oai_records(spark: SparkSession, path: str) -> DataFrame:
    """Read saved harvest pages (XML) with Spark's XML source."""
    return record_columns(_xml(spark.read).load(path))


def stream_oai_records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same pages as a stream of newly landed files."""
    return record_columns(_xml(spark.readStream.options(**options)).load(path))


def write_oai_pages(papers: DataFrame, path: str) -> None:
    """Write records in the harvested layout (``authors`` is an array of structs)."""
    record = papers.select(
        F.struct(F.col("Date").alias("datestamp")).alias("header"),
        F.struct(
            F.struct(
                F.col("arXiv_id").alias("id"), F.col("Title").alias("title"),
                F.struct(F.col("authors").alias("author")).alias("authors"),
                F.col("MSCs").alias("msc-class"), F.col("Abstract").alias("abstract"),
            ).alias("arXiv")
        ).alias("metadata"),
    )
    record.write.format("xml").option("rootTag", "ListRecords").option("rowTag", RECORD_TAG).save(path)


def check_day(day: str) -> str:
    """Accept ``YYYY-MM-DD`` only."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        raise ValueError(f"not a date of the form YYYY-MM-DD: {day!r}")
    dt.date.fromisoformat(day)
    return day


def harvest_range(records: DataFrame, start: str | None = None, end: str | None = None, date: str = "Date") -> DataFrame:
    """Records with a date in [start, end]; by default from the first day to today."""
    first = check_day(start or FIRST_DAY)
    last = check_day(end or dt.date.today().isoformat())
    # ISO dates sort as text, so the filter is pushed to the scan as it stands.
    return records.filter(F.col(date).between(first, last))


def harvest_union(pages: DataFrame, id_col: str = "arXiv_id", latest: str | None = None) -> DataFrame:
    """One row per paper over (cumulative) pages; with ``latest`` a row with the highest value.

    Copies of a paper are identical without ``latest``, so any one is kept. With
    it, the highest value per paper is found on two narrow columns, and whole
    records of that value alone go on. Copies are combined before the shuffle, so a
    paper with many of them is no hot spot.
    """
    if latest is not None:
        best = pages.groupBy(id_col).agg(F.max(latest).alias("_best"))
        kept = pages.join(best, id_col, "left")
        pages = kept.filter(F.col(latest).eqNullSafe(F.col("_best"))).select(*pages.columns)
    return pages.dropDuplicates([id_col]).select(*pages.columns)
