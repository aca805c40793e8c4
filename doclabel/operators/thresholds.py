"""Decision thresholds per class, chosen by F-beta on a grid.

At one threshold for all classes, gap filling makes a class predicted exactly if
its score exceeds the threshold or it is the best class of its row. So every
(row, class) cell falls into one grid bucket, and reverse cumulative sums over
the (class, bucket) histogram give the counts at every threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclabel.functions.arrays import argmax, one_hot, with_value
from doclabel.staging import stage

# Grid sizes, thresholds before fitting, decimals that decide ties.
GRID_PER_CLASS = 50
GRID_SINGLE = 30
DEFAULT_THRESHOLD = 0.2
DEFAULT_SINGLE_THRESHOLD = 0.5
TIE_DECIMALS = 12


def fbeta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    """F-beta from counts, 0 where undefined."""
    weight = beta * beta
    bottom = F.lit(1 + weight) * tp + F.lit(weight) * fn + fp
    return F.when(bottom > 0, F.lit(1 + weight) * tp / bottom).otherwise(F.lit(0.0))


def _bucket(p: Column, grid: int) -> Column:
    """How many of the grid points k / (grid - 1) lie below ``p``."""
    guess = F.least(F.greatest(F.ceil(p * (grid - 1)).cast("int"), F.lit(0)), F.lit(grid))
    up = (guess < grid) & (guess / F.lit(grid - 1) < p)
    down = (guess > 0) & ((guess - 1) / F.lit(grid - 1) >= p)
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def counts_on_grid(scores: DataFrame, grid: int) -> DataFrame:
    """``(class_id, k, threshold, tp, fp, fn)`` for every class and grid point.

    ``scores`` has arrays ``p`` (scores) and ``y`` (0/1 truth) per row.
    """
    zipped = F.zip_with("p", "y", lambda score, truth: F.struct(score.alias("p"), truth.alias("y")))
    cells = scores.select(argmax(F.col("p")).alias("best"), F.posexplode(zipped).alias("class_id", "c"))
    bucket = F.when(F.col("class_id") == F.col("best"), F.lit(grid)).otherwise(_bucket(F.col("c.p"), grid))
    histogram = cells.groupBy("class_id", bucket.alias("b")).agg(
        F.sum(F.col("c.y").cast("bigint")).alias("pos"), F.count("*").alias("n")
    )
    # At most grid + 1 rows per class: stored, so that the scores are read once.
    histogram = stage(histogram, "histogram")
    classes = histogram.groupBy("class_id").agg(F.sum("pos").alias("positives"))
    zero = F.lit(0).cast("bigint")
    empty = classes.select("class_id", F.explode(F.sequence(F.lit(1), F.lit(grid))).alias("b"), zero.alias("pos"), zero.alias("n"))
    filled = histogram.unionByName(empty).groupBy("class_id", "b").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    above = Window.partitionBy("class_id").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    running = filled.select(
        "class_id", "b", F.sum("pos").over(above).alias("tp"), F.sum("n").over(above).alias("predicted")
    ).filter(F.col("b") >= 1)
    k = F.col("b") - 1
    return running.join(classes, "class_id").select(
        "class_id", k.alias("k"), (k / F.lit(grid - 1)).alias("threshold"), "tp",
        (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("positives") - F.col("tp")).alias("fn"),
    )


def fit_thresholds(
    scores: DataFrame, refinement: int = GRID_PER_CLASS, beta: float = 1.0, labels: DataFrame | None = None
) -> DataFrame:
    """Per class the first grid point with the best F-beta: ``(class_id, threshold, f_beta, label)``.

    ``labels`` (class_id, label) names the classes; by default their number does.
    """
    curve = counts_on_grid(scores, refinement).select(
        "class_id", "k", "threshold",
        F.round(fbeta(F.col("tp"), F.col("fp"), F.col("fn"), beta), TIE_DECIMALS).alias("f_beta"),
    )
    first = Window.partitionBy("class_id").orderBy(F.desc("f_beta"), "k")
    best = curve.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("class_id", "threshold", "f_beta")
    if labels is None:
        return best.withColumn("label", F.col("class_id").cast("string"))
    return best.join(labels, "class_id")


def threshold_curve(scores: DataFrame, refinement: int = GRID_SINGLE) -> DataFrame:
    """Mean F1 over classes at each common threshold: ``(k, threshold, f1)``."""
    return counts_on_grid(scores, refinement).groupBy("k", "threshold").agg(
        F.round(F.avg(fbeta(F.col("tp"), F.col("fp"), F.col("fn"))), TIE_DECIMALS).alias("f1")
    )


def fit_single_threshold(scores: DataFrame, refinement: int = GRID_SINGLE) -> DataFrame:
    """The first common threshold with the best mean F1 (one row)."""
    return threshold_curve(scores, refinement).orderBy(F.desc("f1"), "k").limit(1).select("threshold", "f1")


def fill_gaps(p: Column, predicted: Column) -> Column:
    """Rows without a class get their best one."""
    return F.when(
        F.aggregate(predicted, F.lit(0), lambda n, x: n + x) == 0,
        with_value(argmax(p), lambda best: one_hot(best, F.size(p))),
    ).otherwise(predicted)


def threshold_values(thresholds: DataFrame) -> list[float]:
    """The fitted thresholds in class order (one number per class)."""
    return [row["threshold"] for row in thresholds.orderBy("class_id").collect()]


def predict_thresholds(df: DataFrame, thresholds: list[float] | float = DEFAULT_THRESHOLD, p: str = "p", fill: bool = True) -> DataFrame:
    """Add ``y_hat``: class i is predicted if its score exceeds threshold i; then gaps are filled."""
    if isinstance(thresholds, list):
        above = F.zip_with(p, F.lit([float(t) for t in thresholds]), lambda x, t: (x > t).cast("int"))
    else:
        above = F.transform(p, lambda x: (x > F.lit(float(thresholds))).cast("int"))
    raw = df.withColumn("y_hat", above)
    return raw.withColumn("y_hat", fill_gaps(F.col(p), F.col("y_hat"))) if fill else raw
