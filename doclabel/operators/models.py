"""Classifiers: unigram topics, feed-forward network, scoring of a given sequence model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclabel.functions.arrays import argmax, log_sum_exp, normalise, with_value
from doclabel.operators.dictionary import Sent, added_gains, known_ids, sent_once, unfolded
from doclabel.operators.lookup import lookup_join, measured_bytes
from doclabel.staging import stage

# Words that a task holds before it adds up their counts per class.
HELD = 1 << 23


@dataclass
class UnigramModel:
    """Word distributions per class, kept as observed counts plus class totals.

    ``cells`` (label_id, word_id, key, n), ``labels`` (label_id, code, n_words):
    a word never seen in a class has probability 1 / (n_words + vocab_size).
    """

    cells: DataFrame
    labels: DataFrame
    vocab_size: int

    def topics(self) -> DataFrame:
        """Smoothed P(word | class) of the observed cells, and of unseen words (``p_unseen``)."""
        total = F.col("n_words") + self.vocab_size
        return self.cells.join(self.labels.select("label_id", "n_words"), "label_id").select(
            "label_id", "word_id", "key", ((F.col("n") + 1) / total).alias("p"), (F.lit(1.0) / total).alias("p_unseen")
        )


def train_unigram(
    docs: DataFrame, vocab: DataFrame, bank: DataFrame, words: str = "Abstract", codes: str = "MSCs"
) -> UnigramModel:
    """Count words per class; a paper counts for each of its codes, unknown ones are skipped."""
    ids = known_ids(known_ids(docs.select(codes, words), vocab, words), bank, codes)
    counts = _class_counts(ids, codes, words, (bank.agg(F.max("id")).first()[0] or 0) + 1)
    cells = counts.join(vocab.select("key", F.col("id").alias("word_id")), "word_id")
    cells = cells.select(F.col("label_id").cast(bank.schema["id"].dataType).alias("label_id"), F.col("word_id").cast(vocab.schema["id"].dataType).alias("word_id"), "key", "n")
    cells = stage(cells, "cells")  # the totals, the scorer and whoever stores the model read them
    totals = cells.groupBy("label_id").agg(F.sum("n").alias("n_words"))
    labels = bank.select(F.col("id").alias("label_id"), F.col("key").alias("code")).join(totals, "label_id", "left")
    labels = labels.withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    return UnigramModel(cells, labels, vocab.count())


def _class_counts(ids: DataFrame, labels: str, words: str, n_labels: int) -> DataFrame:
    """``(label_id, word_id, n)``: a word counts once for each label of its text.

    Counts are added up within a task, over as many words as ``HELD`` allows, before they are shuffled.
    """

    def summed(codes: list[np.ndarray]) -> pa.RecordBatch:
        code = np.sort(np.concatenate(codes))
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        code, n = code[starts], np.diff(np.append(starts, len(code)))
        return pa.RecordBatch.from_arrays([pa.array(code % n_labels), pa.array(code // n_labels), pa.array(n)], ["label_id", "word_id", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = [], 0
        for rows, flat, offsets in unfolded(batches, 1):
            word, sizes = flat.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets)
            label, many = rows.column(0).flatten().to_numpy(zero_copy_only=False), rows.column(0).value_lengths().to_numpy(zero_copy_only=False)
            own, first = np.repeat(np.arange(len(rows)), sizes), np.cumsum(many) - many
            for k in range(many.max(initial=0)):  # the k-th label of every text that has one
                has = many[own] > k
                codes.append(word[has] * n_labels + label[(first + k)[own[has]]])
                held += len(codes[-1])
            if held >= HELD:
                yield summed(codes)
                codes, held = [], 0
        if held:
            yield summed(codes)

    rows = ids.select(labels, words).mapInArrow(count, "label_id bigint, word_id bigint, n bigint")
    return rows.groupBy("word_id", "label_id").agg(F.sum("n").alias("n"))


@dataclass
class Scorer:
    """A unigram model made ready for scoring: one staged row per vocabulary word.

    A row is sparse: the classes (``labels``) in which the word was seen, and how
    often (``gains``; in log mode the logarithm is taken when a text meets the
    word). ``size`` is the table's measured size.
    """

    by_word: DataFrame | Sent
    smoothing: list[float]
    mode: str
    size: int

    def sent(self) -> Scorer:
        """The same with its table at the executors, for texts that come in parts."""
        return Scorer(sent_once(self.by_word.select("key", "labels", "gains"), self.size), self.smoothing, self.mode, self.size)


def prepare_scorer(model: UnigramModel, vocab: DataFrame, mode: str = "linear") -> Scorer:
    """``linear`` weighs classes by the sum of P(word | class) over the words (null without
    a known word); ``log`` is naive Bayes with equal priors."""
    if mode not in ("linear", "log"):
        raise ValueError("mode must be 'linear' or 'log'")
    totals = model.labels.select("n_words").orderBy("label_id").collect()  # one number per class
    # As narrow as the numbers allow: every task reads the whole table.
    label = "tinyint" if len(totals) < 1 << 7 else "smallint" if len(totals) < 1 << 15 else "int"
    gain = "int" if all(r["n_words"] < 1 << 31 for r in totals) else "bigint"
    cell = F.struct(F.col("label_id").cast(label).alias("label_id"), F.col("n").cast(gain).alias("gain"))
    per_word = model.cells.groupBy("key").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    cells = F.coalesce("cells", F.array().cast(f"array<struct<label_id: {label}, gain: {gain}>>"))
    by_word = vocab.select("key").join(per_word, "key", "left").select("key", cells.alias("cells"))
    by_word = stage(by_word.select("key", F.col("cells.label_id").alias("labels"), F.col("cells.gain").alias("gains")), "scorer")
    return Scorer(by_word, [float(r["n_words"] + model.vocab_size) for r in totals], mode, measured_bytes(by_word))


def score_classes(docs: DataFrame, scorer: Scorer, id_col: str = "paper_id", words: str = "Abstract") -> DataFrame:
    """``(id_col, p)``: class probabilities of each word list, in label id order.

    A block of documents, as sparse word counts, is multiplied with a block of the
    scorer's sparse rows where the documents are; no document is shuffled.
    """
    sums = added_gains(docs, scorer.by_word, id_col, words, len(scorer.smoothing), "_sums", scorer.size, scorer.mode == "log")
    return sums.select(id_col, _probabilities(F.col("_sums"), scorer.smoothing, scorer.mode).alias("p"))


def class_scores(
    docs: DataFrame,
    model: UnigramModel,
    vocab: DataFrame,
    mode: str = "linear",
    id_col: str = "paper_id",
    words: str = "Abstract",
) -> DataFrame:
    """Prepare the model and score the word lists with it."""
    return score_classes(docs, prepare_scorer(model, vocab, mode), id_col, words)


def _probabilities(sums: Column, smoothing: list[float], mode: str) -> Column:
    """From the added gains (place 0: known words, then one per class)."""
    known = F.get(sums, F.lit(0))
    own = F.slice(sums, 2, len(smoothing))
    pairs = F.zip_with(own, F.lit(smoothing), lambda gain, divisor: (gain + known) / divisor if mode == "linear" else gain - known * F.log(divisor))
    if mode == "linear":
        return with_value(pairs, normalise)
    return with_value(
        pairs, lambda scores: with_value(log_sum_exp(scores), lambda z: F.transform(scores, lambda s: F.exp(s - z)))
    )


# --- feed-forward network -------------------------------------------------------


def train_mlp(
    train: DataFrame,
    hidden: list[int],
    n_features: int,
    n_classes: int,
    features: str = "vector",
    label: str = "y",
    max_iter: int = 100,
    block_size: int = 128,
    step_size: float = 0.03,
    solver: str = "l-bfgs",
    seed: int = 0,
) -> MultilayerPerceptronClassificationModel:
    """Fit MLlib's feed-forward classifier on document vectors."""
    data = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    trainer = MultilayerPerceptronClassifier(
        layers=[n_features, *hidden, n_classes], maxIter=max_iter, blockSize=block_size, stepSize=step_size,
        solver=solver, seed=seed,
    )
    return trainer.fit(data)


def predict_mlp(df: DataFrame, model: MultilayerPerceptronClassificationModel, features: str = "vector") -> DataFrame:
    """Add ``p``, the class probabilities."""
    ready = df.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    scored = model.transform(ready)
    return scored.select(*df.columns, vector_to_array("probability").alias("p"))


# --- sequence model given by the caller -------------------------------------------


def score_sequences(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable],
    n_steps: int,
    dim: int,
    batch_size: int = 64,
    x: str = "x",
    name: str = "logits",
) -> DataFrame:
    """Add the logits of padded sequences; ``make_predict_fn`` loads the caller's model
    on the executor and returns a function from (batch, n_steps, dim) to (batch, classes)."""
    score = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[[n_steps, dim]],
    ).asNondeterministic()  # the model runs once per row, whatever filters follow
    return df.withColumn("_flat", F.flatten(x)).withColumn(name, score("_flat")).drop("_flat")


def prefix_predictions(
    df: DataFrame,
    vectors: DataFrame,
    bank: DataFrame,
    make_predict_fn: Callable[[], Callable],
    dim: int,
    n_steps: int = 20,
    view_length: int = 15,
    id_col: str = "paper_id",
    words: str = "Abstract",
) -> DataFrame:
    """Predicted class after each known word: ``(id_col, n_words, word, key, description)``.

    Only the first ``view_length`` words count, and of these only those that have
    a vector; ``n_words`` numbers them from 1. Every word is looked up once, every
    prefix scored once, and the classes are joined without a shuffle if they are few.
    """
    viewed = df.select(id_col, F.posexplode(F.slice(words, 1, min(view_length, n_steps))).alias("_pos", "word"))
    found = lookup_join(viewed, vectors.select("word", "vector"), "word")
    known = found.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_pos", "word", "vector"))).alias("_known"))
    prefixes = known.select(id_col, "_known", F.explode(F.sequence(F.lit(1), F.size("_known"))).alias("n_words"))
    steps = F.transform(F.slice("_known", F.lit(1), F.col("n_words")), lambda s: s["vector"])
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), dim), F.lit(n_steps) - F.col("n_words"))
    filled = prefixes.select(id_col, "n_words", F.get("_known", F.col("n_words") - 1)["word"].alias("word"), F.concat(steps, zeros).alias("x"))
    scored = score_sequences(filled, make_predict_fn, n_steps, dim)
    best = scored.select(id_col, "n_words", "word", argmax(F.col("logits")).alias("id"))
    return lookup_join(best, bank, "id").select(id_col, "n_words", "word", "key", "description")
