"""Raw, processed and training tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclabel.functions.codes import check_depth, codes_at_depth
from doclabel.operators.labels import as_code_list

# Column names and the full code length.
TEXT, CODES = "Abstract", "MSCs"
FULL_DEPTH = 5


def select_column(df: DataFrame, column: str) -> DataFrame:
    return df.select(column)


def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_raw_columns(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text and codes of a raw table (and ``keep`` columns); a missing path gives an empty table."""
    try:
        return spark.read.parquet(path).select(*keep, TEXT, CODES)
    except AnalysisException as error:
        if not _is_missing(error):
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*keep, TEXT, CODES)))


def load_processed(spark: SparkSession, path: str, depth: int = FULL_DEPTH) -> DataFrame:
    """Processed papers with the codes cut to ``depth`` (5 leaves them as stored)."""
    return at_depth(spark.read.parquet(path), depth)


def at_depth(df: DataFrame, depth: int = FULL_DEPTH, codes: str = CODES) -> DataFrame:
    """Cut list codes to distinct prefixes and a single code to its prefix."""
    check_depth(depth)
    if depth == FULL_DEPTH:
        return df
    if df.schema[codes].dataType.typeName() == "string":
        return df.withColumn(codes, F.substring(codes, 1, depth))
    return as_code_list(df, codes).withColumn(codes, codes_at_depth(F.col(codes), depth))


def save_training_set(df: DataFrame, path: str, kind: str, depth: int) -> None:
    """Store a training set under its kind and depth."""
    df.write.mode("overwrite").parquet(f"{path}/kind={kind}/depth={check_depth(depth)}")


def load_training_set(spark: SparkSession, path: str, kind: str, depth: int = FULL_DEPTH) -> DataFrame:
    """Load one training set; only its partition folder is read."""
    folder = f"{path}/kind={kind}/depth={check_depth(depth)}"
    return spark.read.parquet(folder)


def demo_examples(spark: SparkSession, path: str) -> DataFrame:
    """Example table ``(sentence, codes, description)`` for demonstrations."""
    return spark.read.parquet(path).select("sentence", "codes", "description")
