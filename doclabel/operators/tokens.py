"""From word lists to the words and phrases of a vocabulary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclabel.functions.text import clean_words, sample_words, whitespace_words, word_candidates
from doclabel.operators.dictionary import Sent, rewritten
from doclabel.operators.lookup import lookup_join


def with_clean_words(df: DataFrame, text: str = "Abstract") -> DataFrame:
    """Replace a text column by its list of clean words."""
    return df.withColumn(text, clean_words(F.col(text)))


@dataclass
class Extent:
    """Range of document ids, longest word list, and the last document that has words."""

    low: int
    high: int
    longest: int
    last_id: int | None
    last_length: int | None


def corpus_extent(df: DataFrame, id_col: str = "paper_id", words: str = "Abstract") -> Extent:
    """One pass over the list lengths, no word is unfolded."""
    length = F.greatest(F.size(words), F.lit(0))
    row = df.agg(
        F.min(id_col).alias("low"),
        F.max(id_col).alias("high"),
        F.max(length).alias("longest"),
        F.max(F.when(length > 0, F.col(id_col))).alias("last_id"),
        F.max_by(length, F.when(length > 0, F.col(id_col))).alias("last_length"),
    ).first()
    return Extent(row["low"] or 0, row["high"] or 0, row["longest"] or 0, row["last_id"], row["last_length"])


def explode_words(df: DataFrame, *keep: str, words: str = "Abstract") -> DataFrame:
    """One row per word: ``(*keep, pos, word)``."""
    return df.select(*keep, F.posexplode(words).alias("pos", "word"))


def tag_words(tokens: DataFrame, lexicon: DataFrame, default: str = "NN") -> DataFrame:
    """Add the part of speech of each word from a ``(word, tag)`` lexicon."""
    tagged = lookup_join(tokens, lexicon.select("word", F.col("tag").alias("_tag")), "word", how="left")
    return tagged.select(*tokens.columns, F.coalesce("_tag", F.lit(default)).alias("tag"))


def tag_sentences(df: DataFrame, tagger: Callable[[Column], Column], *keep: str, words: str = "Abstract") -> DataFrame:
    """Tag whole sentences with the caller's function ``array<string> -> array<string>``.

    ``tagger`` is any Column function, e.g. a Pandas UDF around a trained tagger.
    """
    tagged = df.select(*keep, F.col(words).alias("_words"), tagger(F.col(words)).alias("_tags"))
    zipped = F.zip_with("_words", "_tags", lambda word, tag: F.struct(word.alias("word"), tag.alias("tag")))
    return tagged.select(*keep, F.posexplode(zipped).alias("pos", "_t")).select(*keep, "pos", "_t.*")


def selected_tokens(
    df: DataFrame,
    vocab: DataFrame,
    *keep: str,
    words: str = "Abstract",
    keep_last: bool = False,
) -> DataFrame:
    """Words and phrases of each text that are in the vocabulary, one row each.

    ``vocab`` has one row per ``key``; its other columns come along.
    """
    candidates = df.select(*keep, F.posexplode(word_candidates(F.col(words), keep_last)).alias("pos", "key"))
    return lookup_join(candidates, vocab, "key")


def gather(tokens: DataFrame, item: str, *by: str, order: str = "pos", name: str = "Abstract") -> DataFrame:
    """Collect the items of each document back into an ordered array."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("v"))))
    return tokens.groupBy(*by).agg(F.transform(ordered, lambda x: x["v"]).alias(name))


def select_in_vocab(
    df: DataFrame,
    vocab: DataFrame | Sent,
    words: str = "Abstract",
    keep_last: bool = False,
) -> DataFrame:
    """Rewrite each word list to the in-vocabulary words and phrases, in order.

    Texts without any such word stay, with an empty list. Each list is rewritten
    where it is: the vocabulary visits the texts, and no text is shuffled.
    """
    return rewritten(df, vocab, words, keep_last)


def sample_selected_words(
    df: DataFrame,
    vocab: DataFrame,
    n_words: int = 25,
    seed: int = 0,
    id_col: str = "paper_id",
    text: str = "Abstract",
) -> DataFrame:
    """Draw ``n_words`` in-vocabulary words of each text, with replacement."""
    split = df.withColumn(text, whitespace_words(F.col(text)))
    selected = select_in_vocab(split, vocab, text)
    return selected.withColumn(text, sample_words(F.col(text), F.col(id_col), n_words, seed))
