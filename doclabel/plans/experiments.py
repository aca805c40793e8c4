"""Classification experiments end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclabel.functions.arrays import argmax
from doclabel.operators.metrics import top_k_accuracy, top_k_label_mass
from doclabel.operators.models import class_scores, score_sequences, train_unigram
from doclabel.operators.splits import N_STEPS
from doclabel.plans.training import rnn_training_set, unigram_test_matrices, unigram_training_set
from doclabel.sources.tables import at_depth
from doclabel.staging import stage


def unigram_experiment(
    processed: DataFrame, vocab: DataFrame, bank: DataFrame, depth: int = 2, mode: str = "linear", id_col: str = "paper_id"
) -> DataFrame:
    """Train on the first 80 %, score the rest: ``(id_col, best, p, y)`` per test paper."""
    split = stage(unigram_training_set(at_depth(processed, depth), id_col), "split")
    model = train_unigram(split.filter(F.col("split") == "train"), vocab, bank)
    test = split.filter(F.col("split") == "test")
    scored = class_scores(test, model, vocab, mode, id_col)
    _, truth = unigram_test_matrices(split, vocab, bank, id_col=id_col)
    return scored.join(truth, id_col).select(id_col, argmax(F.col("p")).alias("best"), "p", "y")


def unigram_quality(scored: DataFrame, k: int = 3) -> DataFrame:
    """Mean label weight among the ``k`` best classes of the scored papers."""
    return top_k_label_mass(scored.filter(F.col("p").isNotNull()), k)


def sequence_experiment(
    processed: DataFrame,
    vectors: DataFrame,
    bank: DataFrame,
    make_predict_fn: Callable[[], Callable],
    dim: int,
    depth: int = 2,
    n_steps: int = N_STEPS,
    k: int = 3,
    id_col: str = "paper_id",
) -> DataFrame:
    """Top-k accuracy of a given sequence model per split."""
    samples = rnn_training_set(at_depth(processed, depth), vectors, bank, dim, n_steps, id_col=id_col)
    scored = score_sequences(samples, make_predict_fn, n_steps, dim)
    return top_k_accuracy(scored, k, "logits", "y", by=["split"])
