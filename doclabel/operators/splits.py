"""Position-based splits, slices, mini-batches and sequence features.

Positions come from sorting the key column alone; the wide rows are then split
by comparing keys with the boundary values and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclabel.operators.lookup import lookup_join
from doclabel.operators.ordering import before, boundaries, with_dense_id

# Fixed values of the original experiments.
SHUFFLE_SEED = 73
TAIL_PERCENT = 10
N_STEPS = 50


def shuffle_order(id_col: str = "paper_id", seed: int = SHUFFLE_SEED) -> list[Column]:
    """Order key of a seeded shuffle, md5("id:seed"); the same for any partitioning."""
    return [F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), F.col(id_col)]


def shuffle_seeded(df: DataFrame, id_col: str = "paper_id", seed: int = SHUFFLE_SEED) -> DataFrame:
    """Add the ``position`` of each row in a seeded shuffle of the table."""
    key, own = shuffle_order(id_col, seed)
    ranked = with_dense_id(df.select(F.col(id_col), key.alias("_key")), "_key", id_col, name="position")
    return df.join(ranked.select(id_col, "position"), id_col)


def _split(df: DataFrame, order: list[Column], names: list[str], positions) -> DataFrame:
    _, keys = boundaries(df, order, positions)
    split = F.lit(names[-1])
    for name, key in reversed(list(zip(names, keys))):
        split = F.when(before(order, key), F.lit(name)).otherwise(split)
    return df.withColumn("split", split)


def split_80_20(df: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """First int(0.8 n) rows are ``train``, the rest ``test``."""
    return _split(df, [F.col(id_col)], ["train", "test"], lambda n: [int(n * 0.8)])


def split_80_10_10(df: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """``train``, ``test`` and ``validation`` by position."""
    return _split(
        df, [F.col(id_col)], ["train", "test", "validation"], lambda n: [n * 80 // 100, n * 90 // 100]
    )


def split_tail(df: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """The last 10 % of the rows, at most ``limit`` if given, are ``test``; with fewer than 10 rows none."""
    share = lambda n: n * TAIL_PERCENT // 100
    return _split(df, order, ["train", "test"], lambda n: [n - (share(n) if limit is None else min(share(n), limit))])


def slice_train(df: DataFrame, start: int, stop: int, id_col: str = "paper_id") -> DataFrame:
    """Training rows at positions [start, stop); other rows stay."""
    train = F.col("split") == "train"
    order = [F.col(id_col)]
    _, (first, end) = boundaries(df.filter(train), order, lambda n: [start, stop])
    inside = F.lit(False) if first is None else ~before(order, first) & before(order, end)
    return df.filter(~train | inside)


def mini_batches(df: DataFrame, batch_size: int, id_col: str = "paper_id") -> DataFrame:
    """Add the ``batch`` number by position; an incomplete last batch is dropped."""
    ranked = with_dense_id(df.select(id_col), id_col, name="_rank")
    full = ranked.count() // batch_size
    batches = ranked.select(id_col, F.floor(F.col("_rank") / batch_size).alias("batch"))
    return df.join(batches.filter(F.col("batch") < full), id_col)


def with_sequence_length(df: DataFrame, words: str = "Abstract") -> DataFrame:
    """Number of words before trimming (words without a vector count too)."""
    return df.withColumn("length", F.size(words))


def padded_sequence(
    df: DataFrame,
    vectors: DataFrame,
    dim: int,
    n_steps: int = N_STEPS,
    id_col: str = "paper_id",
    words: str = "Abstract",
) -> DataFrame:
    """Add ``x``: vectors of the known words among the first ``n_steps``, padded with
    zero rows to ``n_steps``; and ``effective_length``, the number of known words."""
    steps = df.select(id_col, F.posexplode(F.slice(words, 1, n_steps)).alias("pos", "word"))
    known = lookup_join(steps, vectors.select("word", "vector"), "word")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", "vector"))), lambda r: r["vector"])
    stacked = known.groupBy(id_col).agg(rows.alias("_rows"))
    found = F.coalesce("_rows", F.array().cast("array<array<float>>"))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), dim), F.lit(n_steps) - F.size(found))
    joined = df.join(stacked, id_col, "left")
    return joined.select(*df.columns, F.concat(found, zeros).alias("x"), F.size(found).alias("effective_length"))
