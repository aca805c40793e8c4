"""Persist and restore containers, label banks and models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclabel.functions.codes import check_depth
from doclabel.operators.models import UnigramModel
from doclabel.sources.label_bank import default_bank

BANK_SCHEMA = "key string, id int, description string"


def save_container(container: DataFrame, path: str) -> None:
    container.write.mode("overwrite").parquet(path)


def load_container(spark: SparkSession, path: str) -> DataFrame:
    """A stored container; ``id`` carries the order and ``key`` identifies the rows."""
    return spark.read.parquet(path).orderBy("id")


def save_label_bank(bank: DataFrame, path: str) -> None:
    bank.select("key", "id", "description").write.mode("overwrite").option("header", "true").csv(path)


def load_label_bank(spark: SparkSession, source: int | str) -> DataFrame:
    """Bank ``(key, id, description)`` from a CSV path, or the built-in one of a code length.

    Only two-character codes are built in; longer banks are tables of the caller.
    A path that cannot be read gives an empty bank.
    """
    if isinstance(source, int):
        if check_depth(source) != 2:
            raise ValueError("no built-in bank of this code length: pass the path of a CSV table")
        return default_bank(spark)
    try:
        return spark.read.schema(BANK_SCHEMA).option("header", "true").option("mode", "FAILFAST").csv(source)
    except AnalysisException:
        return spark.createDataFrame([], BANK_SCHEMA)


def save_unigram(model: UnigramModel, vocab: DataFrame, path: str) -> None:
    """Store counts, class table and vocabulary side by side."""
    model.cells.write.mode("overwrite").parquet(f"{path}/cells")
    model.labels.write.mode("overwrite").parquet(f"{path}/labels")
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")


def load_unigram(spark: SparkSession, path: str) -> tuple[UnigramModel, DataFrame]:
    vocab = spark.read.parquet(f"{path}/vocab")
    model = UnigramModel(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/labels"), vocab.count())
    return model, vocab


def save_table(df: DataFrame, path: str) -> None:
    """Word vectors, thresholds, splits and text vectors are plain tables."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_ml_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_thresholds(spark: SparkSession, path: str) -> list[float]:
    rows = spark.read.parquet(path).orderBy(F.col("class_id")).select("threshold").collect()
    return [row["threshold"] for row in rows]
