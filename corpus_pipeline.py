"""Training-data pipeline: classify, dedup lines, drop near copies, decontaminate, mix.

Every stage gets what the stage before it kept, written as Parquet and read
again, and returns rows with the columns of documents; the last adds a copy
number. ``run`` applies the stages to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclabel.llm import decontaminate, lines, mixing, neardup, quality
from doclabel.llm.common import fresh
from doclabel.staging import stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the quality classifier scores at its threshold or above."""
    scorer = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "score")
    return quality.score_quality(docs, scorer, name).filter(F.col(name) >= quality.THRESHOLD).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines found in many documents from every text."""
    return lines.dedup_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every near-duplicate component."""
    return neardup.dedup_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least one word in 20 lies in benchmark passages."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's rate says."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]
ORACLE_SQL = None  # a fitted classifier comes first, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
