"""Vocabulary: counting tagged words, ids, lookups and container algebra.

A container is a DataFrame with a unique ``key``, a dense ``id`` from 0 and
feature columns (for a vocabulary ``tag`` and ``freq``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclabel.operators.lookup import lookup_join
from doclabel.operators.ordering import with_dense_id
from doclabel.operators.tokens import Extent

# Tags and limits that make a word suitable.
SUITABLE_TAGS = ("NNP", "NN", "NNS", "JJ")
PROPER_NOUN = "NNP"
MIN_WORD_LENGTH = 4
MIN_PROPER_NOUN_LENGTH = 3
MIN_FREQUENCY = 4


def tag_counts(tagged: DataFrame) -> DataFrame:
    """Occurrences of each (word, tag)."""
    return tagged.groupBy("word", "tag").agg(F.count("*").alias("freq"))


def is_suitable(
    min_freq: int = MIN_FREQUENCY,
    min_word_len: int = MIN_WORD_LENGTH,
    min_proper_noun_len: int = MIN_PROPER_NOUN_LENGTH,
) -> Column:
    length = F.length("word")
    return (F.col("freq") >= min_freq) & (
        (F.col("tag").isin(*SUITABLE_TAGS) & (length >= min_word_len))
        | ((F.col("tag") == PROPER_NOUN) & (length >= min_proper_noun_len))
    )


def vocab_filter(counts: DataFrame, **limits: int) -> DataFrame:
    """Keep frequent (word, tag) pairs of a suitable part of speech and length."""
    return counts.filter(is_suitable(**limits))


def _position_key(extent: Extent, id_col: str) -> Column:
    """(document, position) as one value whose minimum a hash aggregate can keep.

    Packed into a 64-bit integer when the ranges fit, else into a decimal.
    """
    pos_bits = max(1, int(extent.longest).bit_length())
    low = F.lit(extent.low).cast("bigint")
    if (extent.high - extent.low).bit_length() + pos_bits <= 62:
        return F.shiftleft(F.col(id_col).cast("bigint") - low, pos_bits) + F.col("pos")
    wide = F.col(id_col).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(12,0)")
    return (wide + F.col("pos").cast("decimal(12,0)")).cast("decimal(38,0)")


def _tagged_extent(tagged: DataFrame, id_col: str) -> Extent:
    low, high, last = tagged.agg(F.min(id_col), F.max(id_col), F.max("pos")).first()
    return Extent(low or 0, high or 0, (last or 0) + 1, None, None)


def build_vocab(
    tagged: DataFrame, id_col: str = "paper_id", extent: Extent | None = None, **limits: int
) -> DataFrame:
    """Vocabulary ``(key, id, tag, freq)`` from tagged words ``(id_col, pos, word, tag)``.

    Ids follow the first occurrence of a word's first surviving (word, tag)
    pair; tag and frequency are those of its surviving pair seen first latest.
    ``extent`` saves a pass over the tokens if the range of ids is known.
    """
    extent = extent or _tagged_extent(tagged, id_col)
    pairs = (
        tagged.withColumn("_at", _position_key(extent, id_col))
        .groupBy("word", "tag")
        .agg(F.count("*").alias("freq"), F.min("_at").alias("_at"))
        .filter(is_suitable(**limits))
    )
    words = pairs.groupBy(F.col("word").alias("key")).agg(
        F.max_by(F.struct("tag", "freq"), "_at").alias("_last"), F.min("_at").alias("_first")
    )
    words = words.select("key", F.col("_last.tag").alias("tag"), F.col("_last.freq").alias("freq"), "_first")
    return with_dense_id(words, "_first").select("key", "id", "tag", "freq")


def proper_nouns(container: DataFrame) -> DataFrame:
    return container.filter(F.col("tag") == PROPER_NOUN)


def count_proper_nouns(container: DataFrame) -> DataFrame:
    return container.agg(F.count_if(F.col("tag") == PROPER_NOUN).alias("n_proper_nouns"))


def lookup_keys(keys: DataFrame, container: DataFrame) -> DataFrame:
    """Features of the given keys; unknown keys give nulls."""
    return keys.join(container, "key", "left")


def lookup_ids(ids: DataFrame, container: DataFrame) -> DataFrame:
    """Features of the given ids; unknown ids give nulls."""
    return ids.join(container, "id", "left")


def id_slice(container: DataFrame, start: int, stop: int) -> DataFrame:
    return container.filter((F.col("id") >= start) & (F.col("id") < stop))


def contained(keys: DataFrame, container: DataFrame) -> DataFrame:
    return keys.join(container, "key", "left_semi")


def container_size(container: DataFrame) -> DataFrame:
    return container.agg(F.count("*").alias("size"))


def container_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Merge two containers of the same type.

    Keys of ``left`` keep their place and features, with ``freq`` summed where
    both have it; new keys follow in the order of ``right``.
    """
    if [(f.name, f.dataType) for f in left.schema.fields] != [(f.name, f.dataType) for f in right.schema.fields]:
        raise TypeError("only containers of the same type can be merged")
    features = [c for c in left.columns if c not in ("key", "id")]
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    merged = both.groupBy("key").agg(
        F.min_by(F.struct("_side", "id", *features), "_side").alias("_f"),
        *([F.sum("freq").alias("_freq")] if "freq" in features else []),
    )
    values = [F.col("_freq").alias(c) if c == "freq" else F.col(f"_f.{c}").alias(c) for c in features]
    merged = merged.select("key", *values, F.col("_f._side").alias("_side"), F.col("_f.id").alias("_old"))
    return with_dense_id(merged, "_side", "_old").select(*left.columns)


def keep_keys(container: DataFrame, keys: DataFrame, order: str) -> DataFrame:
    """Keep the listed keys that exist, in list order (column ``order`` of ``keys``)."""
    kept = container.drop("id").join(keys.select("key", F.col(order).alias("_order")), "key")
    return with_dense_id(kept, "_order").select(*container.columns)


def remove_keys(container: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop the listed keys; the order of the others stays."""
    kept = container.join(keys.select("key"), "key", "left_anti").withColumnRenamed("id", "_old")
    return with_dense_id(kept, "_old").select(*container.columns)


def sorted_by(container: DataFrame, attribute: str, descending: bool = True) -> DataFrame:
    """Re-number a container by a feature; ties keep their order."""
    renamed = container.withColumn("_old", F.col("id")).withColumn("_by", F.col(attribute))
    first = F.desc("_by") if descending else F.asc("_by")
    return with_dense_id(renamed, first, "_old").select(*container.columns)


def multi_hot(items: DataFrame, container: DataFrame, id_col: str = "paper_id", item: str = "key") -> DataFrame:
    """Sparse count vectors ``(id_col, id, n)`` of the items found in the container."""
    found = lookup_join(items.select(id_col, F.col(item).alias("key")), container.select("key", "id"), "key")
    return found.groupBy(id_col, "id").agg(F.count("*").alias("n"))


def as_sparse_arrays(cells: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Sparse cells to one row per document with parallel ``indices`` and ``counts``."""
    ordered = F.sort_array(F.collect_list(F.struct("id", "n")))
    grouped = cells.groupBy(id_col).agg(ordered.alias("_c"))
    return grouped.select(id_col, F.col("_c.id").alias("indices"), F.col("_c.n").alias("counts"))


def describe(container: DataFrame) -> DataFrame:
    """One line of text per row; the layout depends on the container's columns."""
    columns = set(container.columns)
    # The line formats.
    if "mutual_info" in columns:
        line = F.format_string("Phrase: %s %s, POS tags: %s, %s", "w1", "w2", "tag1", "tag2")
    elif "tfidf" in columns:
        line = F.format_string("word: %s, POS tag: %s, idf: %.3f, tfidf: %.3f", "key", "tag", "idf", "tfidf")
    elif "description" in columns:
        line = F.format_string("Code: %s, description: %s", "key", "description")
    else:
        line = F.format_string("word: %s, POS tag: %s", "key", "tag")
    return container.select("id", line.alias("line"))

