"""Training sets for the three kinds of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclabel.functions.arrays import normalise
from doclabel.operators import labels, splits
from doclabel.operators.vectors import N_WORDS, doc_vector_concat
from doclabel.operators.dictionary import counted
from doclabel.staging import stage


def unigram_training_set(processed: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """The papers with a ``split`` column: train (first 80 %) and test."""
    return splits.split_80_20(processed, id_col)


def unigram_test_matrices(
    split: DataFrame, vocab: DataFrame, bank: DataFrame, per_code_counts: bool = False, id_col: str = "paper_id"
) -> tuple[DataFrame, DataFrame]:
    """Test side: sparse word counts ``(id_col, id, n)`` and label distributions ``(id_col, y)``.

    ``per_code_counts`` counts every word once per code of its paper.
    """
    test = split.filter(F.col("split") == "test")
    counts = counted(test.select(id_col, "Abstract"), vocab, id_col, "Abstract")
    if per_code_counts:
        sizes = test.select(id_col, F.size("MSCs").alias("_codes"))
        counts = counts.join(sizes, id_col).select(id_col, "id", (F.col("n") * F.col("_codes")).alias("n"))
    truth = labels.multi_label_vector(test.select(id_col, "MSCs"), bank)
    truth = truth.withColumn("y", F.transform("y", lambda n: n.cast("double")))
    return counts, truth.select(id_col, normalise(F.col("y")).alias("y"))


def t2v_training_set(
    vectors: DataFrame, bank: DataFrame, vector: str = "vector", codes: str = "MSCs", id_col: str = "paper_id"
) -> DataFrame:
    """Document vectors with class vectors ``y``; empty ones dropped, then split 80/10/10."""
    ready = labels.multi_label_vector(vectors, bank, codes)
    ready = stage(ready.filter((F.size(vector) > 0) & (F.size("y") > 0)), "ready")  # the split counts ids in several passes
    return splits.split_80_10_10(ready, id_col)


def t2v_from_papers(
    papers: DataFrame,
    vectors: DataFrame,
    bank: DataFrame,
    dim: int,
    n_words: int = N_WORDS,
    seed: int = 0,
    id_col: str = "paper_id",
    text: str = "Abstract",
    codes: str = "MSCs",
) -> DataFrame:
    """From papers (raw texts, lists of codes) to ``(id_col, vector, y, split)``.

    A text's vector is that of its sampled words end to end, ``y`` marks all of its classes.
    """
    made = doc_vector_concat(papers.select(id_col, text, codes), vectors, dim, n_words, seed, id_col, text)
    return t2v_training_set(made.drop(text), bank, "vector", codes, id_col).select(id_col, "vector", "y", "split")


def rnn_training_set(
    processed: DataFrame,
    vectors: DataFrame,
    bank: DataFrame,
    dim: int,
    n_steps: int = splits.N_STEPS,
    selection: list[str] | None = None,
    id_col: str = "paper_id",
    test_limit: int | None = None,
    primary: bool = True,
) -> DataFrame:
    """Sequence samples ``(id_col, x, length, effective_length, y, split)``.

    ``y`` is the class index of the first code or, without ``primary``, the 0/1
    vector of all codes over the bank.

    Papers whose first code is in the bank (restricted to ``selection``) are
    shuffled with a fixed seed and the tail of that order, 10 % or at most
    ``test_limit`` rows, is the test set.
    """
    papers = processed
    if selection is not None:
        papers, bank = labels.select_labels(papers, bank, selection)
    papers = labels.primary_label(papers, bank)
    papers = labels.label_index(papers, bank) if primary else labels.multi_label_vector(papers, bank)
    papers = splits.split_tail(papers, splits.shuffle_order(id_col), test_limit)
    papers = splits.with_sequence_length(papers.select(id_col, "Abstract", "y", "split"))
    filled = splits.padded_sequence(papers, vectors, dim, n_steps, id_col)
    return filled.select(id_col, "x", "length", "effective_length", "y", "split")
