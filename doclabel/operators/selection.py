"""The k-th row of a table in a total order, without sorting the table.

The range of the leading key is cut into equal parts and the rows of each part
are counted, with the least and the greatest key met in it. The part that holds
the wanted row is cut again, until it has a few rows, which are fetched, or a
single key, when the next key of the order decides. A pass reads the key columns
only and sends a bounded number of counts to the driver; each pass narrows the
range about a thousandfold, so a handful of passes do for any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of one pass, and the rows of a part that are fetched instead of cutting it further.
PARTS, FEW = 1024, 2048
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Whole numbers up to here are exact as doubles.
_EXACT = 1 << 53


def selectable(df: DataFrame, order: list[Column], fractions: bool = True) -> bool:
    """Whether all keys are numbers (whole ones, without ``fractions``), whose ranges can be cut."""
    kinds = (*WHOLE, T.DoubleType, T.FloatType) if fractions else WHOLE
    return all(isinstance(f.dataType, kinds) for f in df.select(*order).schema.fields)


def numbers_first(column: Column, descending: bool = False, fractional: bool = True) -> list[Column]:
    """Ascending keys, without null and NaN, that order numbers as a sort does.

    Ascending: nulls first, NaN last; descending: the other way round.
    """
    sign = -1 if descending else 1
    ranks = [F.when(column.isNull(), -sign).otherwise(0)]
    value = F.coalesce(column, F.lit(0))
    if fractional:
        ranks.append(F.when(F.isnan(column), sign).otherwise(0))
        value = F.nanvl(F.coalesce(column.cast("double"), F.lit(0.0)), F.lit(0.0))
    return [*ranks, -value if descending else value]


def _part_of(key: Column, low, high, whole: bool) -> Column:
    """Number of the part that a key within [low, high] falls into; never falls as the key grows."""
    if whole and high - low < _EXACT:
        share = (key - F.lit(low)).cast("double") / F.lit(float(high - low))
    else:
        width = float(high) / 2 - float(low) / 2  # halves: the difference of two doubles may be too large for one
        share = (key.cast("double") / 2 - F.lit(float(low) / 2)) / F.lit(width)
    return F.least(F.floor(share * PARTS), F.lit(PARTS - 1))


def keys_at(df: DataFrame, order: list[Column], positions: Callable[[int], list[int]]) -> tuple[int, list[tuple | None] | None]:
    """Row count, and the keys of the rows at ``positions(row count)`` (from 0) of the ascending order.

    A position past the ends gives None. With a null among the keys there is no list.
    """
    names = [f"_k{i}" for i in range(len(order))]
    keys = df.select(*[c.alias(n) for c, n in zip(order, names)])
    spans = [x for n in names for x in (F.min(n).alias(f"{n}_low"), F.max(n).alias(f"{n}_high"), F.count(n).alias(f"{n}_count"))]
    whole_table = keys.agg(F.count("*").alias("n"), *spans).first()
    n = whole_table["n"]
    if any(whole_table[f"{name}_count"] < n for name in names):
        return n, None
    return n, [_key_at(keys, names, whole_table, p) if 0 <= p < n else None for p in positions(n)]


def _key_at(keys: DataFrame, names: list[str], spans: Row, position: int) -> tuple:
    """``position`` counts from the first row of ``here``, the ``left`` rows that agree in the keys settled so far."""
    here, left, settled = keys, spans["n"], []
    for name in names:
        whole = isinstance(keys.schema[name].dataType, WHOLE)
        low, high = spans[f"{name}_low"], spans[f"{name}_high"]
        if low != high and left < spans["n"]:
            low, high = here.agg(F.min(name), F.max(name)).first()
        while low != high:
            if left <= FEW:
                return tuple(sorted(here.collect())[position])
            part = _part_of(F.col(name), low, high, whole)
            counts = here.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
            for row in sorted(counts.collect(), key=lambda r: r["part"]):  # PARTS rows at most
                if position < row["n"]:
                    break
                position -= row["n"]
            left, low, high = row["n"], row["low"], row["high"]
            here = here.filter(F.col(name).between(F.lit(low), F.lit(high)))
        settled.append(low)
    return tuple(settled)


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in the ascending order of ``order`` (numbers without null and NaN); not sorted.

    Rows that share all keys of the ``n``-th row come along.
    """
    if n <= 0:
        return df.limit(0)
    _, (last,) = keys_at(df, order, lambda _: [n - 1])
    if last is None:
        return df
    types = [f.dataType for f in df.select(*order).schema.fields]
    return df.filter(F.struct(*order) <= F.struct(*[F.lit(k).cast(t) for k, t in zip(last, types)]))
