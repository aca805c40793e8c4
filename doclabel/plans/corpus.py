"""Raw papers to a processed corpus and its vocabulary with phrases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclabel.functions.text import clean_words
from doclabel.operators.labels import clean_codes, drop_unusable
from doclabel.operators.phrases import PHRASE_SHARE, build_phrases, phrases_to_vocab
from doclabel.operators.tokens import corpus_extent, select_in_vocab
from doclabel.operators.vocab import build_vocab, container_union
from doclabel.staging import stage

Tagger = Callable[[DataFrame], DataFrame]


@dataclass
class Corpus:
    papers: DataFrame
    vocab: DataFrame


def clean_papers(raw: DataFrame, bank: DataFrame, depth: int, text: str = "Abstract", codes: str = "MSCs") -> DataFrame:
    """Word lists and valid codes of each paper."""
    return clean_codes(raw, bank, depth, codes).withColumn(text, clean_words(F.col(text)))


def build_phrase_vocab(
    sentences: DataFrame,
    tagger: Tagger,
    share: float = PHRASE_SHARE,
    id_col: str = "paper_id",
    words: str = "Abstract",
    cross_document: bool = True,
    **limits: int,
) -> DataFrame:
    """Vocabulary of words and of the phrases they form.

    ``tagger`` adds a ``tag`` column to tokens ``(id_col, pos, word)``.
    """
    tokens = sentences.select(id_col, F.posexplode(words).alias("pos", "word"))
    extent = corpus_extent(sentences, id_col, words)
    vocab = build_vocab(tagger(tokens), id_col, extent, **limits)
    phrases = build_phrases(sentences, vocab, share, cross_document, id_col=id_col, words=words, extent=extent)
    return container_union(vocab, phrases_to_vocab(phrases))


def process_corpus(
    raw: DataFrame,
    bank: DataFrame,
    tagger: Tagger,
    depth: int = 5,
    share: float = PHRASE_SHARE,
    id_col: str = "paper_id",
    text: str = "Abstract",
    codes: str = "MSCs",
) -> Corpus:
    """Clean texts and codes, learn the vocabulary, rewrite the texts, drop unusable papers.

    The cleaned words are staged once: vocabulary, phrases and rewriting all read them.
    """
    cleaned = stage(clean_papers(raw.select(id_col, text, codes), bank, depth, text, codes), "cleaned")
    vocab = build_phrase_vocab(cleaned, tagger, share, id_col, text)
    labelled = cleaned.filter(F.size(codes) > 0)
    papers = drop_unusable(select_in_vocab(labelled, vocab, text), codes, text)
    return Corpus(papers, vocab)


def tag_by(rule: str) -> Tagger:
    """A tagger from a SQL expression over ``word`` and ``pos``."""
    return lambda tokens: tokens.withColumn("tag", F.expr(rule))
