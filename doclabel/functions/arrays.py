"""Score vectors held as ``array<double>``, one row per sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A higher-order function evaluates its body for every element, so anything
    that is constant within the row is bound outside of it first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def identity(values: Column) -> Column:
    return values


def sigmoid(values: Column) -> Column:
    return F.transform(values, lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def normalise(values: Column) -> Column:
    """Divide by the sum; null where the sum is zero."""
    return with_value(
        array_sum(values),
        lambda total: F.when(total != 0, F.transform(values, lambda x: x / total)),
    )


def softmax(values: Column) -> Column:
    """Row-wise softmax; the values are shifted by their maximum against overflow."""
    return with_value(
        F.array_max(values),
        lambda top: with_value(F.transform(values, lambda z: F.exp(z - top)), normalise),
    )


def log_sum_exp(values: Column) -> Column:
    return with_value(
        F.array_max(values),
        lambda top: top + F.log(array_sum(F.transform(values, lambda z: F.exp(z - top)))),
    )


def argmax(values: Column) -> Column:
    """Zero-based position of the largest value, the lowest one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(position: Column, size: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: (i == position).cast("int")
    )


def rank_of(values: Column, position: Column) -> Column:
    """How many values are strictly larger than the one at ``position``."""
    return with_value(
        F.get(values, position), lambda own: F.size(F.filter(values, lambda x: x > own))
    )
