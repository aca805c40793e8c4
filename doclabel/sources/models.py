"""Model store: fitted models of every kind below one path, loaded again by their kind.

A stored model is a folder with a manifest (one JSON row: its kind and single
values) and, by kind, its tables or what MLlib's own writer makes:

* ``unigram``: class counts, classes and vocabulary
* ``thresholds``: class_id, threshold and label
* ``vectors``: word vectors
* ``ml``: any MLlib model or pipeline model, the stages of this package included

The manifest is written last and a model is replaced by writing its tables
anew, so a folder without manifest is an unfinished one and cannot be loaded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclabel.operators.models import UnigramModel, predict_mlp, prepare_scorer, score_classes
from doclabel.operators.thresholds import predict_thresholds, threshold_values


@dataclass
class StoredUnigram:
    """A unigram model with its vocabulary."""

    model: UnigramModel
    vocab: DataFrame

    def predict(self, docs: DataFrame, mode: str = "linear", id_col: str = "paper_id", words: str = "Abstract") -> DataFrame:
        return score_classes(docs, prepare_scorer(self.model, self.vocab, mode), id_col, words)


@dataclass
class StoredThresholds:
    """One decision threshold per class."""

    table: DataFrame

    def predict(self, scored: DataFrame, p: str = "p", fill: bool = True) -> DataFrame:
        return predict_thresholds(scored, threshold_values(self.table), p, fill)


@dataclass
class StoredVectors:
    """Word vectors."""

    table: DataFrame


@dataclass
class StoredML:
    """A model of MLlib, or a pipeline of stages."""

    model: Any

    def predict(self, df: DataFrame, features: str | None = None) -> DataFrame:
        """What the model adds to the rows; with ``features``, class probabilities ``p`` from that vector column."""
        return self.model.transform(df) if features is None else predict_mlp(df, self.model, features)


Stored = StoredUnigram | StoredThresholds | StoredVectors | StoredML


def _tables(model: Stored) -> tuple[str, dict[str, DataFrame]]:
    if isinstance(model, StoredUnigram):
        return "unigram", {"cells": model.model.cells, "labels": model.model.labels, "vocab": model.vocab}
    if isinstance(model, StoredThresholds):
        return "thresholds", {"table": model.table}
    if isinstance(model, StoredVectors):
        return "vectors", {"table": model.table}
    raise TypeError(f"not a model of the store: {type(model).__name__}")


def save_model(spark: SparkSession, model: Stored, path: str) -> None:
    """Store a model; one that is there already is replaced.

    A model must not be saved over the folder that its own tables are read from.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(path, "manifest"), True)
    if isinstance(model, StoredML):
        kind = "ml"
        model.model.write().overwrite().save(f"{path}/model")
    else:
        kind, tables = _tables(model)
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    size = model.model.vocab_size if isinstance(model, StoredUnigram) else None
    manifest = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(size).cast("bigint").alias("vocab_size"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_model(spark: SparkSession, path: str) -> Stored:
    """The model stored at ``path``, whatever its kind."""
    manifest = spark.read.schema("kind string, vocab_size bigint").json(f"{path}/manifest").first()
    read: Callable[[str], DataFrame] = lambda name: spark.read.parquet(f"{path}/{name}")
    if manifest["kind"] == "unigram":
        return StoredUnigram(UnigramModel(read("cells"), read("labels"), manifest["vocab_size"]), read("vocab"))
    if manifest["kind"] == "thresholds":
        return StoredThresholds(read("table"))
    if manifest["kind"] == "vectors":
        return StoredVectors(read("table"))
    if manifest["kind"] == "ml":
        return StoredML(_load_ml(spark, f"{path}/model"))
    raise ValueError(f"unknown kind of model: {manifest['kind']!r}")


def _load_ml(spark: SparkSession, path: str) -> Any:
    """A model by the class that its own metadata names."""
    name = DefaultParamsReader.loadMetadata(path, spark)["class"]
    if name.endswith(".PipelineModel"):
        return PipelineModel.load(path)
    return DefaultParamsReader.loadParamsInstance(path, spark)
