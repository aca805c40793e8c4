"""Bigram phrases: adjacent in-vocabulary words ranked by mutual information."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclabel.operators.dictionary import last_words, unfolded, with_ids
from doclabel.operators.lookup import lookup_join
from doclabel.operators.ordering import with_dense_id
from doclabel.operators.tokens import Extent, corpus_extent
from doclabel.session import ship_package
from doclabel.staging import passing, stage

# Share of the vocabulary size kept as phrases, decimals that decide ties.
PHRASE_SHARE = 0.7
TIE_DECIMALS = 9
SKETCH_ACCURACY = 1000
# Pairs that a task holds before it adds them up.
HELD = 1 << 22


def phrase_word_stream(
    df: DataFrame,
    vocab: DataFrame,
    id_col: str = "paper_id",
    words: str = "Abstract",
    extent: Extent | None = None,
) -> DataFrame:
    """In-vocabulary words of the whole corpus as one stream, one ordered array per document.

    The stream runs through the documents in id order. Its elements are vocabulary
    ids (column ``stream``). The very last word of the corpus belongs to no pair
    start and is left out; documents without an in-vocabulary word have no row.
    """
    extent = extent or corpus_extent(df, id_col, words)
    placed = with_ids(df.select(id_col, words), vocab, words, "stream").select(id_col, "stream")
    if extent.last_id is not None:
        shorter = F.slice("stream", F.lit(1), F.greatest(F.size("stream") - 1, F.lit(0)))
        placed = placed.withColumn("stream", F.when(F.col(id_col) == extent.last_id, shorter).otherwise(F.col("stream")))
    return placed.withColumn("stream", F.filter("stream", lambda x: x >= 0)).filter(F.size("stream") > 0)


def _border_pairs(stream: DataFrame, id_col: str) -> DataFrame:
    """(last word of a document, first word of the next one) over all documents."""
    edges = stream.select(id_col, F.get("stream", F.lit(0)).alias("first"), F.element_at("stream", -1).alias("last"))
    placed = with_dense_id(edges, id_col, name="place")
    nobody = F.lit(None).cast("bigint")
    ends = placed.select((F.col("place") + 1).alias("place"), F.col("last").alias("w1"), nobody.alias("w2"))
    starts = placed.select("place", nobody.alias("w1"), F.col("first").alias("w2"))
    meeting = ends.unionByName(starts)
    return (
        meeting.groupBy("place").agg(F.max("w1").alias("id1"), F.max("w2").alias("id2"))
        .filter(F.col("id1").isNotNull() & F.col("id2").isNotNull())
        .select("id1", "id2")
    )


def _inside_pairs(stream: DataFrame) -> DataFrame:
    """Counts of neighbours within the documents ``(id1, id2, freq)``, added up over as many texts as ``HELD`` allows."""
    ship_package(stream.sparkSession)

    def batch_of(firsts: list[np.ndarray], seconds: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        order = np.argsort((a << 32) | b) if b.max() < 1 << 31 and a.max() < 1 << 31 else np.lexsort((b, a))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(np.diff(np.append(starts, len(a))))], ["id1", "id2", "freq"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds, held = [], [], 0
        for _, flat, offsets in unfolded(batches, 0):
            ids = flat.to_numpy(zero_copy_only=False).astype(np.int64)
            opens = np.ones(len(ids), bool)
            opens[last_words(offsets)] = False
            at = np.flatnonzero(opens)
            if len(at):
                firsts.append(ids[at])
                seconds.append(ids[at + 1])
                held += len(at)
            if held >= HELD:
                yield batch_of(firsts, seconds)
                firsts, seconds, held = [], [], 0
        if held:
            yield batch_of(firsts, seconds)

    return stream.select("stream").mapInArrow(count, "id1 bigint, id2 bigint, freq bigint")


def pair_counts(stream: DataFrame, cross_document: bool = True, id_col: str = "paper_id") -> DataFrame:
    """Counts of neighbouring vocabulary ids ``(id1, id2, freq)`` in the stream.

    With ``cross_document`` the last word of a document meets the first word of
    the next document that has any.
    """
    pairs = _inside_pairs(stream)
    if cross_document:
        pairs = pairs.unionByName(_border_pairs(stream, id_col).withColumn("freq", F.lit(1).cast("bigint")))
    return pairs.groupBy("id1", "id2").agg(F.sum("freq").alias("freq"))


def with_words(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add the words and tags ``(w1, w2, tag1, tag2)`` of pairs of ids."""
    for side in ("1", "2"):
        names = vocab.select(F.col("id").alias("id" + side), F.col("key").alias("w" + side), F.col("tag").alias("tag" + side))
        pairs = lookup_join(pairs, names, "id" + side)
    return pairs


def context_counts(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Pair counts with the words spelled out: ``(w1, w2, freq)``."""
    return with_words(counts, vocab).select("w1", "w2", "freq")


def _information(zero_cells: str) -> Column:
    """Mutual information from integer counts: pair n, firsts n1 and n2, total N."""
    n, n1, n2, total = (F.col(c) for c in ("freq", "n1", "n2", "total"))
    p1, p2 = n1 / total, n2 / total
    cells = [
        (total - n1 - n2 + n, (1 - p1) * (1 - p2)),
        (n2 - n, (1 - p1) * p2),
        (n1 - n, p1 * (1 - p2)),
        (n, p1 * p2),
    ]
    smallest = F.least(*[count for count, _ in cells])
    usable = (smallest > 0) if zero_cells == "drop" else (smallest >= 0)
    score = F.lit(0.0)
    for count, product in cells:
        joint = count / total
        term = joint * F.log2(joint / product)
        score = score + (term if zero_cells == "drop" else F.when(count > 0, term).otherwise(F.lit(0.0)))
    return F.when(usable & (n1 > 0) & (n2 > 0) & (n1 < total) & (n2 < total), score).otherwise(F.lit(0.0))


def mutual_information(counts: DataFrame, zero_cells: str = "drop") -> DataFrame:
    """Score every observed pair: ``(id1, id2, freq, mutual_info)``.

    Marginals are those of the first position. ``zero_cells='drop'`` scores pairs
    with an empty cell 0; ``'limit'`` lets an empty cell add 0 (0 log 0 = 0).
    """
    if zero_cells not in ("drop", "limit"):
        raise ValueError("zero_cells must be 'drop' or 'limit'")
    counts = stage(counts, "pairs")
    firsts = stage(counts.groupBy(F.col("id1").alias("id")).agg(F.sum("freq").alias("n")), "firsts")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scored = lookup_join(counts, firsts.select(F.col("id").alias("id1"), F.col("n").alias("n1")), "id1")
    seconds = firsts.select(F.col("id").alias("id2"), F.col("n").alias("n2"))
    scored = lookup_join(scored, seconds, "id2", how="left")
    scored = scored.withColumn("n2", F.coalesce("n2", F.lit(0))).withColumn("total", F.lit(total).cast("bigint"))
    return scored.select("id1", "id2", "freq", _information(zero_cells).alias("mutual_info"))


def top_phrases(scored: DataFrame, vocab: DataFrame, n_phrases: int) -> DataFrame:
    """The ``n_phrases`` pairs with the highest positive score, numbered in (w1, w2) order.

    A quantile sketch of the scores gives a cut that leaves little more than the
    wanted pairs to name and sort; if it leaves too few, all pairs are sorted.
    """
    score = F.floor(F.col("mutual_info") * 10**TIE_DECIMALS + F.lit(0.5))
    informative = stage(scored.filter(F.col("mutual_info") > 0).withColumn("_score", score), "scored")
    total = informative.count()
    if n_phrases < total:
        share = max(0.0, 1 - n_phrases / total - 2 / SKETCH_ACCURACY)
        cut = informative.agg(F.percentile_approx("_score", share, SKETCH_ACCURACY)).first()[0]
        likely = informative.filter(F.col("_score") >= cut)
        if likely.count() >= n_phrases:
            informative = likely
    named = with_words(informative, vocab)
    ranked = with_dense_id(named, F.desc("_score"), "w1", "w2", name="_rank").filter(F.col("_rank") < n_phrases)
    columns = ["w1", "w2", "id", "tag1", "tag2", "mutual_info", "freq"]
    return with_dense_id(ranked.drop("_rank", "_score", "id1", "id2"), "w1", "w2").select(*columns)


@passing
def build_phrases(
    df: DataFrame,
    vocab: DataFrame,
    share: float = PHRASE_SHARE,
    cross_document: bool = True,
    zero_cells: str = "drop",
    id_col: str = "paper_id",
    words: str = "Abstract",
    extent: Extent | None = None,
) -> DataFrame:
    """Phrases of a corpus: the best ``int(share * vocabulary size)`` pairs.

    The tables of pairs on the way, larger than the texts, do not stay in the scratch folder.
    """
    stream = phrase_word_stream(df, vocab, id_col, words, extent)
    if cross_document:
        stream = stage(stream, "stream")
    scored = mutual_information(pair_counts(stream, cross_document, id_col), zero_cells)
    return top_phrases(scored, vocab, int(share * vocab.count()))


def phrases_to_vocab(phrases: DataFrame) -> DataFrame:
    """Phrases as vocabulary rows: key ``w1_w2``, tag pair ``tag1,tag2``."""
    return phrases.select(
        F.concat_ws("_", "w1", "w2").alias("key"), "id", F.concat_ws(",", "tag1", "tag2").alias("tag"), "freq"
    )
