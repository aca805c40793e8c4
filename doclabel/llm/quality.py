"""Quality classifier by positive-unlabelled learning (non-negative risk).

Trusted positives and unlabelled web text train a linear scorer of text
statistics. With class prior p, positive risk R+ and unlabelled risk R-, the
risk is p R+(pos) + max(0, R-(unl) - p R-(pos)): where the second part falls
below zero the step goes against it instead, so negatives are never overfitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclabel.llm.common import Rolling, flat_bytes, fresh, range_hashes, row_groups, segments, word_spans, word_table
from doclabel.session import ship_package

SAMPLE = 20_000  # rows at most of each of the two training samples
STEPS, RATE, DECAY = 1500, 0.05, 1e-4
THRESHOLD = 0.7

# Byte classes whose shares are features.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "bang": b"!?", "bar": b"|_~^`\\", "symbol": b"#*$%&<>@=+{}[]", "stop": b".,;:", "quote": b"'\"()/-", "white": b" \t\r\x0b\x0c", "line": b"\n", "control": bytes([*range(9), *range(14, 32), 127])}
NAMES = [*_CLASSES, "non_ascii", "mean_word", "long_words", "repeat_next", "repeat_second", "distinct", "size"]
_code = np.full(256, len(_CLASSES) + 1, np.int64)
for _i, _members in enumerate(_CLASSES.values()):
    _code[list(_members)] = _i
_code[0x80:] = len(_CLASSES)
_INSIDE, _ = word_table(b" \t\n\x0b\x0c\r")


def features(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; null and empty texts give zeros. Uses the bytes of the text alone."""
    data, offsets = flat_bytes(texts)
    n, k = len(offsets) - 1, len(_CLASSES) + 2
    counts, words = np.zeros((n, k)), np.zeros((n, 6))
    for chunk, local, rows, _ in segments(data, offsets, Rolling.LIMIT):
        m = len(rows)
        owner = np.repeat(np.arange(m), np.diff(local))
        np.add.at(counts, rows, np.bincount(owner * k + _code[chunk], minlength=m * k).reshape(m, k))
    for a, b in row_groups(offsets, Rolling.LIMIT):  # bytes add up over pieces of a long text, its words are counted in one
        m, chunk, local = b - a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, bounds = word_spans(chunk, local, _INSIDE)
        if not len(starts):
            continue
        row = np.repeat(np.arange(m), np.diff(bounds))
        hashes = range_hashes(chunk, starts, ends)
        distinct = _distinct(row, hashes)
        same1 = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        same2 = (hashes[2:] == hashes[:-2]) & (row[2:] == row[:-2])
        size = lambda x: np.bincount(x, minlength=m)
        words[a:b] = np.stack([
            size(row), np.bincount(row, ends - starts, minlength=m), size(row[ends - starts > 20]),
            size(row[1:][same1]), size(row[2:][same2]), size(distinct)], axis=1)
    length, n_words = np.maximum(counts.sum(1, keepdims=True), 1), np.maximum(words[:, :1], 1)
    shares = np.log1p(50 * np.concatenate([counts[:, :-1] / length, words[:, 2:5] / n_words], axis=1))
    byte_shares, word_shares = shares[:, : k - 1], shares[:, k - 1 :]
    return np.concatenate([byte_shares, np.log1p(words[:, 1:2] / n_words), word_shares, words[:, 5:6] / n_words, np.log1p(words[:, :1])], axis=1)


def _distinct(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The rows of the distinct (row, hash) pairs."""
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    return r[np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])]]


@dataclass
class Scorer:
    """Linear scorer of standardised statistics; ``prior`` is the class prior it was fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Scorer:
    """Minimise the non-negative unbiased risk with logistic loss by full-batch Adam; the same input gives the same scorer."""
    both = np.concatenate([positive, unlabelled]) if len(unlabelled) else positive
    width = both.shape[1] if both.ndim == 2 else len(NAMES)
    if not len(positive) or not len(unlabelled):
        return Scorer(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(prior / (1 - prior))), prior)
    mean, scale = both.mean(0), both.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        # Logistic loss as label 1: -log s, gradient s - 1; as label 0: -log(1 - s), gradient s.
        up_pos, down_pos, down_unl = p.T @ (sp - 1) / len(p), p.T @ sp / len(p), u.T @ su / len(u)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        gradient = prior * up_pos + (down_unl - prior * down_pos) if negative >= 0 else -(down_unl - prior * down_pos)
        gradient = gradient + decay * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Scorer(mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    """True for the fold kept from training: crc32 of the id as text, modulo 4, is 2. A null id is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _collect_features(rows: DataFrame, most: int) -> np.ndarray:
    """Statistics of a bounded sample of texts, in an order that does not depend on partitions."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    # Rows that repeat an id may exceed the sample; their statistics, not their texts, are cut then.
    got = rows.mapInArrow(stats, "doc_id bigint, x array<double>").limit(most).toPandas()
    if not len(got):
        return np.zeros((0, len(NAMES)))
    got["first"] = got["x"].map(lambda x: tuple(x))
    return np.array(got.sort_values(["doc_id", "first"])["x"].tolist())


def _share(rows: DataFrame, bound: int, on: Column) -> DataFrame:
    """About ``bound`` of ``rows`` (all if there are fewer), chosen by a hash of the id."""
    n = rows.count()
    return rows if n <= bound else rows.filter(F.pmod(F.xxhash64(on, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Fit the scorer on at most about ``sample`` trusted positives and ``sample`` unlabelled texts.

    Labels are read only for ids outside the held-out fold: those labelled 1 are
    the positives, and their share among the labelled is the class prior. All
    other documents, labels unseen, are the unlabelled text. An id with several
    labels counts as 1 only if all are 1. Without positives every score is the prior.
    """
    ship_package(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    prior = min(0.99, max(0.01, 0.5 if share is None else share))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    trusted = _share(known.filter("quality = 1").select("doc_id"), sample, F.col("doc_id"))
    ids = trusted.limit(2 * sample)
    positive = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    # The unlabelled sample is drawn by id first, so that only its own texts are read on.
    drawn = _share(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().join(known, "doc_id", "left_anti"), sample, F.col("doc_id"))
    unlabelled = texts.join(F.broadcast(drawn.limit(2 * sample)), "doc_id", "left_semi")
    return fit_nnpu(_collect_features(positive, 4 * sample), _collect_features(unlabelled, 4 * sample), prior)


def score_quality(docs: DataFrame, scorer: Scorer, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 per row, of its whole text alone.

    Null and empty texts are scored like any other, from statistics that are all
    zero. Repeated rows get the same score. An empty table gives an empty result.
    All columns are kept; ``column`` gets leading underscores if the name is taken. No shuffle.
    """
    ship_package(docs.sparkSession)
    name = fresh(docs, column)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer.scores(features(pa.array(texts, pa.large_string()))))

    return docs.withColumn(name, score(F.col("text")))
