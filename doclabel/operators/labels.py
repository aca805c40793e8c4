"""Subject codes as labels: cleaning, expansion, lookup and filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclabel.functions.codes import codes_at_depth, split_codes
from doclabel.operators.dictionary import with_counts
from doclabel.operators.lookup import lookup_join
from doclabel.operators.ordering import with_dense_id
from doclabel.operators.vocab import keep_keys
from doclabel.staging import stage

# Fixed value: fewest selected words of a usable text.
MIN_WORDS = 10
# Banks up to this number of classes are compared as literals (one hash set); larger ones are joined.
LITERAL_BANK = 20_000


def bank_keys(bank: DataFrame) -> list[str]:
    """Keys of a label bank in id order: one string per class."""
    return [row["key"] for row in bank.select("id", "key").orderBy("id").collect()]


def code_length(bank: DataFrame) -> int:
    """The common length of a bank's codes; at most two lengths visit the driver."""
    lengths = bank.select(F.char_length("key").alias("n")).distinct().limit(2).collect()
    if len(lengths) != 1:
        raise ValueError("the codes of a bank must have one common length")
    return lengths[0]["n"]


def as_code_list(df: DataFrame, codes: str = "MSCs") -> DataFrame:
    """Split packed codes; a column that is a list already stays as it is."""
    if isinstance(df.schema[codes].dataType, T.ArrayType):
        return df
    return df.withColumn(codes, split_codes(F.col(codes)))


def valid_codes(df: DataFrame, bank: DataFrame, codes: str = "MSCs") -> DataFrame:
    """Keep the codes that are in the bank, in order; a bank of any size will do."""
    if bank.count() <= LITERAL_BANK:
        known = bank_keys(bank)
        return df.withColumn(codes, F.filter(codes, lambda code: code.isin(known)))
    numbered = stage(df.withColumn("_row", F.monotonically_increasing_id()), "coded")
    items = numbered.select("_row", F.posexplode(codes).alias("_pos", "key"))
    found = lookup_join(items, bank.select("key").distinct(), "key")
    kept = F.transform(F.sort_array(F.collect_list(F.struct("_pos", "key"))), lambda x: x["key"])
    lists = found.groupBy("_row").agg(kept.alias("_codes"))
    empty = F.when(F.col(codes).isNotNull(), F.array().cast("array<string>"))
    joined = numbered.join(lists, "_row", "left")
    return joined.withColumn(codes, F.coalesce("_codes", empty)).select(df.columns)


def clean_codes(df: DataFrame, bank: DataFrame, depth: int, codes: str = "MSCs") -> DataFrame:
    """Split, cut to ``depth``, de-duplicate and validate the codes of each paper."""
    listed = as_code_list(df, codes)
    return valid_codes(listed.withColumn(codes, codes_at_depth(F.col(codes), depth)), bank, codes)


def explode_labels(df: DataFrame, bank: DataFrame, codes: str = "MSCs") -> DataFrame:
    """One row per paper and distinct valid code; the bank decides the code length."""
    cleaned = clean_codes(df, bank, code_length(bank), codes)
    return cleaned.withColumn(codes, F.explode(codes))


def describe_codes(df: DataFrame, bank: DataFrame, code: str = "MSCs") -> DataFrame:
    """Add ``label_id`` and ``description`` of a single-code column; unknown codes give nulls."""
    details = bank.select(F.col("key").alias(code), F.col("id").alias("label_id"), "description")
    return lookup_join(df, details, code, how="left")


def select_labels(df: DataFrame, bank: DataFrame, selection: list[str], codes: str = "MSCs"):
    """Restrict the bank to ``selection`` (in that order) and the papers to those whose
    first code is selected. Returns ``(papers, bank)``."""
    wanted = df.sparkSession.createDataFrame(
        [(key, place) for place, key in enumerate(selection)], "key string, place int"
    )
    papers = df.filter(F.get(codes, F.lit(0)).isin(selection))
    return papers, keep_keys(bank, wanted, "place")


def drop_unusable(df: DataFrame, codes: str = "MSCs", words: str = "Abstract", min_words: int = MIN_WORDS) -> DataFrame:
    return df.filter((F.size(codes) > 0) & (F.size(words) >= min_words))


def primary_label(df: DataFrame, bank: DataFrame, codes: str = "MSCs", name: str = "code") -> DataFrame:
    """Add the first code; keep papers whose first code is in the bank."""
    own = df.withColumn(name, F.get(codes, F.lit(0)))
    return lookup_join(own, bank.select(F.col("key").alias(name)), name).select(*df.columns, name)


def label_index(df: DataFrame, bank: DataFrame, code: str = "code", name: str = "y") -> DataFrame:
    """Add the class index of a single-code column."""
    return lookup_join(df, bank.select(F.col("key").alias(code), F.col("id").alias(name)), code)


def multi_label_vector(df: DataFrame, bank: DataFrame, codes: str = "MSCs", name: str = "y") -> DataFrame:
    """Add the vector of class counts over the bank, in id order (0/1 for distinct codes)."""
    places = with_dense_id(bank.select("key", F.col("id").alias("_id")), "_id", name="id").select("key", "id")
    return with_counts(df, places, codes, places.count(), name)
