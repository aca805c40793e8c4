"""Dense ids and positions in a total order, without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclabel.operators.selection import keys_at, selectable
from doclabel.staging import stage

_ROW_BITS = (1 << 33) - 1


def with_dense_id(df: DataFrame, *order: Column | str, name: str = "id") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given (total) order.

    The rows are range-sorted and staged once; each row keeps its place within
    its partition, and only one count per partition visits the driver.
    """
    columns = [c for c in df.columns if c != name]
    part, place = _unused(df, "_part"), _unused(df, "_place")
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            *columns,
            F.spark_partition_id().alias(part),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias(place),
        )
    )
    placed = stage(placed, "ordered")
    sizes = {r["part"]: r["n"] for r in placed.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n")).collect()}
    # AQE may merge neighbouring ranges of a small table; their order stays.
    starts, total = [], 0
    for number in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(number, 0)
    start = F.get(F.lit(starts).cast("array<bigint>"), F.col(part))
    return placed.select(*columns, (start + F.col(place)).alias(name))


def _unused(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    used = {c.lower() for c in df.columns}
    while base.lower() in used:
        base = "_" + base
    return base


def boundaries(df: DataFrame, order: list[Column], positions) -> tuple[int, list[list[Column] | None]]:
    """Row count and the order-key values (as literals) found at ``positions(row count)``.

    Only the key columns are read. Numbers are counted by ranges until the wanted
    places are found; other keys are sorted. A position past the end gives None.
    """
    if selectable(df, order, fractions=False):
        total, found = keys_at(df, order, positions)
        if found is not None:
            types = [f.dataType for f in df.select(*order).schema.fields]
            return total, [None if k is None else [F.lit(v).cast(t) for v, t in zip(k, types)] for k in found]
    keys = [c.alias(f"_k{i}") for i, c in enumerate(order)]
    ranked = with_dense_id(df.select(*keys), *[f"_k{i}" for i in range(len(keys))], name="_rank")
    total = ranked.count()
    wanted = positions(total)
    found = {
        row["_rank"]: [F.lit(row[f"_k{i}"]).cast(ranked.schema[f"_k{i}"].dataType) for i in range(len(keys))]
        for row in ranked.filter(F.col("_rank").isin(list(set(wanted)))).collect()
    }
    return total, [found.get(p) for p in wanted]


def before(order: list[Column], boundary: list[Column] | None) -> Column:
    """True for rows strictly before the boundary key (all rows if there is none)."""
    if boundary is None:
        return F.lit(True)
    return F.struct(*order) < F.struct(*boundary)
