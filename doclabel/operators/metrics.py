"""Quality measures over score arrays ``p`` and truth, one row per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclabel.functions.arrays import log_sum_exp, rank_of
from doclabel.operators.thresholds import fbeta

# Fixed value: number of guesses.
N_GUESSES = 3


def fbeta_by_class(predictions: DataFrame, beta: float = 1.0, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """``(class_id, tp, fp, fn, f_beta)`` of 0/1 arrays."""
    zipped = F.zip_with(y, y_hat, lambda truth, guess: F.struct(truth.alias("t"), guess.alias("h")))
    cells = predictions.select(F.posexplode(zipped).alias("class_id", "c")).select("class_id", "c.*")
    counts = cells.groupBy("class_id").agg(
        F.count_if((F.col("t") == 1) & (F.col("h") == 1)).alias("tp"),
        F.count_if((F.col("t") == 0) & (F.col("h") == 1)).alias("fp"),
        F.count_if((F.col("t") == 1) & (F.col("h") == 0)).alias("fn"),
    )
    return counts.withColumn("f_beta", fbeta(F.col("tp"), F.col("fp"), F.col("fn"), beta))


def mean_fbeta(by_class: DataFrame) -> DataFrame:
    return by_class.agg(F.avg("f_beta").alias("mean_f_beta"))


def top_k_accuracy(df: DataFrame, k: int = N_GUESSES, p: str = "p", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Share of rows whose true class has fewer than ``k`` better-scored classes; one row per value of ``by``."""
    hit = (rank_of(F.col(p), F.col(label)) < k).cast("double")
    return df.groupBy(*(by or [])).agg(F.avg(hit).alias("accuracy"))


def top_k_label_mass(df: DataFrame, k: int = N_GUESSES, p: str = "p", weights: str = "y") -> DataFrame:
    """Mean over rows of the label weight among the ``k`` best classes (ties: lower index)."""
    ordered = F.sort_array(
        F.transform(p, lambda x, i: F.struct((-x).alias("s"), i.alias("i"), F.get(weights, i).cast("double").alias("w")))
    )
    mass = F.aggregate(F.slice(ordered, 1, k), F.lit(0.0), lambda total, c: total + c["w"])
    return df.agg(F.avg(mass).alias("label_mass"))


def cross_entropy(df: DataFrame, logits: str = "p", label: str = "label") -> DataFrame:
    """Mean of -log softmax of the true class."""
    loss = log_sum_exp(F.col(logits)) - F.get(logits, F.col(label))
    return df.agg(F.avg(loss).alias("cross_entropy"))


def quadratic_cost(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Half the mean over classes of the summed squared error."""
    squares = F.zip_with(p, y, lambda a, b: (a - b) * (a - b))
    per_class = df.select(F.posexplode(squares).alias("class_id", "e")).groupBy("class_id").agg(F.sum("e").alias("e"))
    return per_class.agg((F.avg("e") / 2).alias("cost"))


def l2_penalty(weights: DataFrame, lambda_: float, batch_size: Column | int, weight: str = "w") -> DataFrame:
    """lambda / (2 m) times the sum of squared weights."""
    return weights.agg((F.sum(F.col(weight) * F.col(weight)) * lambda_ / (2 * batch_size)).alias("penalty"))
