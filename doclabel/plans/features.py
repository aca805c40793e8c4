"""Feature selection: TF-IDF and information gain over a processed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclabel.functions.text import whitespace_words
from doclabel.operators import scores
from doclabel.operators.labels import describe_codes, explode_labels
from doclabel.operators.tokens import select_in_vocab
from doclabel.sources.tables import at_depth


def tfidf_feature_selection(
    processed: DataFrame, vocab: DataFrame, bank: DataFrame, depth: int = 2, n: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """TF-IDF scores over the classes of ``bank``, and the vocabulary of the ``n`` best words."""
    repeated = explode_labels(at_depth(processed, depth), bank)
    labelled = describe_codes(repeated, bank).select(F.col("label_id").alias("label"), "Abstract")
    tfidf = scores.tfidf(vocab, labelled)
    return tfidf, scores.reduce_vocab(vocab, tfidf, n)


def information_gain(
    texts: DataFrame, vocab: DataFrame, text: str = "Abstract", label: str = "label", normalized: bool = False
) -> DataFrame:
    """Information gain of the vocabulary over raw texts with one label each."""
    split = texts.select(label, text).withColumn(text, whitespace_words(F.col(text)))
    # Words and phrases are looked up in the row: only those of the vocabulary are counted and shuffled, once per label.
    chosen = select_in_vocab(split, vocab, text)
    seen = chosen.select(label, F.explode(text).alias("key")).groupBy("key", label).agg(F.count("*").alias("n"))
    cells = seen.join(vocab.select("key", "id"), "key").select("id", label, "n")
    return scores.information_gain(texts, cells, vocab, label, normalized)
