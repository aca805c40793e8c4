"""Joins of many-row tables (tokens) to tables with one row per key.

Token keys follow Zipf's law: one word may fill a third of the table. The keyed
side is broadcast when its measured size allows it. Otherwise the heaviest keys
of the rows are joined by broadcast (their number and measured size are bounded)
and only the long tail, in which no key is heavy, is shuffled. Which keys are
heavy is told by a sample; it steers the plan, every row is joined either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclabel.staging import stage

BROADCAST_BYTES = 64 << 20
HOT_KEYS = 10_000
SAMPLE = 0.01
# Bytes of an array's elements that have fewer than 8.
ELEMENT_BYTES = {"byte": 1, "short": 2, "integer": 4}


def measured_bytes(df: DataFrame) -> int:
    """Approximate in-memory size, summed over the actual values."""
    width = F.lit(16).cast("bigint")
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            size = F.octet_length(value)
        elif isinstance(field.dataType, T.ArrayType) and not isinstance(
            field.dataType.elementType, (T.StringType, T.ArrayType, T.StructType, T.MapType)
        ):
            size = F.size(value) * ELEMENT_BYTES.get(field.dataType.elementType.typeName(), 8)
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            size = F.octet_length(F.to_json(F.struct(value)))
        else:
            size = F.lit(8)
        width = width + F.coalesce(size, F.lit(0)).cast("bigint")
    return df.agg(F.sum(width)).first()[0] or 0


def heavy_keys(rows: DataFrame, on: str, n: int, sample: float) -> DataFrame:
    """The ``n`` most frequent keys of a sample of the rows, heaviest first."""
    seen = rows.select(on).filter(F.col(on).isNotNull())
    if sample < 1:
        seen = seen.sample(sample, seed=0)
    counted = seen.groupBy(on).agg(F.count("*").alias("_n"))
    return counted.orderBy(F.desc("_n"), on).limit(n).select(on)


def lookup_join(
    rows: DataFrame,
    keyed: DataFrame,
    on: str,
    how: str = "inner",
    broadcast_bytes: int | None = None,
    hot_keys: int = HOT_KEYS,
    sample: float | None = None,
    size: int | None = None,
) -> DataFrame:
    """Join ``rows`` to ``keyed`` (one row per ``on``); ``how`` is inner or left.

    ``size`` is the measured size of ``keyed``, if it is known: a stored table is
    measured once and not at every join.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if (size := measured_bytes(keyed) if size is None else size) <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return rows.join(F.broadcast(keyed), on, how)
    share = SAMPLE if sample is None else sample
    heavy = stage(heavy_keys(rows, on, hot_keys, share), "heavy")
    width = measured_bytes(heavy)
    if width > BROADCAST_BYTES:  # long keys: send fewer of them around, or none
        fewer = hot_keys * BROADCAST_BYTES // (2 * width)
        return lookup_join(rows, keyed, on, how, broadcast_bytes, fewer, sample, size) if fewer else rows.join(keyed, on, how)
    hot = stage(keyed.join(F.broadcast(heavy), on, "left_semi"), "hot")
    found = measured_bytes(hot)
    if found > BROADCAST_BYTES and hot_keys > 1:
        # Wide rows: keep as many of the heaviest keys as surely fit.
        fewer = max(1, hot_keys * BROADCAST_BYTES // (2 * found))
        return lookup_join(rows, keyed, on, how, broadcast_bytes, fewer, sample, size)
    hot_side = F.broadcast(hot) if found <= BROADCAST_BYTES else hot
    hot_rows = rows.join(F.broadcast(heavy), on, "left_semi").join(hot_side, on, how)
    tail_rows = rows.join(F.broadcast(heavy), on, "left_anti").join(keyed, on, how)
    return hot_rows.unionByName(tail_rows)
