"""Bucket-pointer refinement, the core of the suffix arrays.

Suffixes lie in buckets; the bucket pointer of a suffix is the place in the
suffix array at which its bucket starts. If buckets hold suffixes that agree in
their first d symbols, sorting a bucket by the pointers of the suffixes d
symbols later makes them agree in 2 d. Pointers of split buckets serve the next
refinement at once, and buckets of one suffix need no further work.
"""

from __future__ import annotations

import numpy as np


def initial(values: np.ndarray) -> np.ndarray:
    """Bucket pointers of suffixes by the order of their first symbols."""
    order = np.argsort(values)
    ordered = values[order]
    return _pointers(order, np.r_[True, ordered[1:] != ordered[:-1]] if len(order) else np.zeros(0, bool))


def _pointers(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    pointers = np.empty(len(order), np.int64)
    pointers[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else 0
    return pointers


def refine(pointers: np.ndarray, later: np.ndarray) -> int:
    """Split buckets in place by ``later``, one small non-negative value per suffix; returns how many suffixes still share a bucket."""
    crowded = np.flatnonzero(np.bincount(pointers, minlength=len(pointers))[pointers] > 1)
    if not len(crowded):
        return 0
    order = np.argsort(pointers[crowded] * (int(later.max()) + 1) + later[crowded])
    at = crowded[order]
    bucket, value = pointers[at], later[at]
    new_bucket = np.r_[True, bucket[1:] != bucket[:-1]]
    new_value = new_bucket | np.r_[True, value[1:] != value[:-1]]
    places = np.arange(len(at))
    start = np.maximum.accumulate(np.where(new_bucket, places, 0))
    pointers[at] = bucket + np.maximum.accumulate(np.where(new_value, places, 0)) - start
    return int(len(at) - np.count_nonzero(new_value & np.r_[new_value[1:], True]))


def suffix_pointers(symbols: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Pointers of all suffixes, ordered by their first ``depth`` symbols; a suffix stops at its own ``end``.

    A suffix that has stopped comes before those that go on.
    """
    n = len(symbols)
    pointers = initial(symbols)
    done, places = 1, np.arange(n)
    while done < depth and n:
        step = min(done, depth - done)
        target = places + step
        inside = target < end
        later = np.where(inside, pointers[np.minimum(target, n - 1)] + 1, 0)
        if not refine(pointers, later):
            break
        done += step
    return pointers
