"""Benchmark decontamination with suffix arrays over the training texts.

Tasks build a suffix array over the words of each shard of documents and binary-
search every test suffix in it. Matches are kept with their places; a document
goes if enough of its words lie in them. Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclabel.llm.buckets import suffix_pointers
from doclabel.llm.common import flat_bytes, fresh, hashed_words, row_groups, word_table
from doclabel.session import ship_package

WINDOW, SHARE = 13, 20
SHARD_WORDS, GROUP_BYTES = 1 << 18, 1 << 20
BLOCK_BYTES = 8 << 20
_INSIDE, _LOW = word_table()
MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])


@dataclass
class TestSuffixes:
    """Words of the test items one after another, and the windows to look for."""

    words: np.ndarray
    starts: np.ndarray  # of each window, in ``words``
    lengths: np.ndarray
    items: np.ndarray  # item id of each window; -1 with ``named`` False for a null id
    named: np.ndarray

    @staticmethod
    def of(ids: list[int | None], texts: pa.Array, window: int) -> TestSuffixes:
        data, offsets = flat_bytes(texts)
        words, bounds = hashed_words(data, offsets, _INSIDE, _LOW)
        sizes = np.diff(bounds)
        counts = np.where(sizes >= window, sizes - window + 1, np.minimum(sizes, 1))
        row = np.repeat(np.arange(len(sizes)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        named = np.array([i is not None for i in ids], bool)
        known = np.array([-1 if i is None else i for i in ids], np.int64)
        return TestSuffixes(words, bounds[:-1][row] + place, np.minimum(sizes[row], window), known[row], named[row])


def _compare(words, end, places, tests: TestSuffixes, window: int) -> np.ndarray:
    """-1, 0, 1: the suffix at ``places`` against each window, as far as the window reaches."""
    result = np.zeros(len(places), np.int8)
    for k in range(window):
        open_ = (result == 0) & (k < tests.lengths)
        if not open_.any():
            break
        at, want = places[open_] + k, tests.words[tests.starts[open_] + k]
        inside = at < end[places[open_]]
        have = words[np.minimum(at, len(words) - 1)]
        result[open_] = np.where(~inside | (have < want), -1, have > want)
    return result


def find(words: np.ndarray, end: np.ndarray, tests: TestSuffixes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All (window number, place) at which a window occurs: one binary search for either end of its run in the suffix array."""
    array = np.argsort(suffix_pointers(words, end, window), kind="stable")
    edges = []
    for after in (False, True):
        low, high = np.zeros(len(tests.starts), np.int64), np.full(len(tests.starts), len(array), np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            sign = _compare(words, end, array[np.minimum(middle, len(array) - 1)], tests, window)
            right = (low < high) & ((sign < 0) | (after & (sign == 0)))
            high = np.where((low < high) & ~right, middle, high)
            low = np.where(right, middle + 1, low)
        edges.append(low)
    counts = edges[1] - edges[0]
    which = np.repeat(np.arange(len(counts)), counts)
    return which, array[np.repeat(edges[0] - (np.cumsum(counts) - counts), counts) + np.arange(len(which))]


def _matches(words, bounds, tests: TestSuffixes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in the words of some rows, shard by shard; neighbours share window - 1 words."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    which, places, at = [], [], 0
    while at < len(words):
        stop = min(at + SHARD_WORDS, len(words))
        w, p = find(words[at:stop], np.minimum(end[at:stop], stop) - at, tests, window)
        which.append(w)
        places.append(p + at)
        if stop == len(words):
            break
        at = stop - window + 1
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(places), np.concatenate(which)]), axis=1)  # overlaps repeat some
    return pairs[1], pairs[0]


def _runs(which, places, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest verbatim matches: windows that follow each other in item and document, joined. (window, place, length)."""
    shift = places - tests.starts[which]
    order = np.lexsort((places, shift, tests.items[which]))
    which, places, shift = which[order], places[order], shift[order]
    item = tests.items[which]
    first = np.r_[True, (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (places[1:] != places[:-1] + 1)]
    heads = np.flatnonzero(first)
    tails = np.r_[heads[1:], len(places)] - 1
    return which[heads], places[heads], places[tails] - places[heads] + tests.lengths[which[heads]]


def _covered(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint [start, end) pairs, flat, that cover the same places."""
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its matches: n_words, hits (flat disjoint [start, end) word ranges), items, matches.

    A test item's windows are its runs of ``window`` words; a shorter item, not
    none, is one window. ``matches`` holds (item_id, first word, words) of the
    longest verbatim matches. The second value names the added columns, which get
    leading underscores where the table has such names.

    The test items visit the driver in blocks of about ``block_bytes``, and every
    document meets every block in one pass each, without a shuffle. Null or empty
    texts have no words. Rows with null or repeated ids are judged one by one;
    windows of an item without id hit, but the item is not listed. Repeated items
    count once by id. Empty tables: no rows, or no hits.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    names = {name: fresh(docs, name) for name in ("n_words", "hits", "items", "matches")}
    kinds = {"n_words": T.LongType(), "hits": T.ArrayType(T.IntegerType()), "items": T.ArrayType(T.LongType()), "matches": T.ArrayType(MATCH)}
    place = docs.columns.index("text")
    out, width = docs, len(docs.columns)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        tests = spark.sparkContext.broadcast(TestSuffixes.of(part["item_id"].to_pylist(), part["text"], window))
        schema = T.StructType(docs.schema.fields + [T.StructField(names[k], kinds[k]) for k in names])
        out = out.mapInArrow(_scanner(tests, window, place, width, list(schema.names)), schema)
    return out, names


def _scanner(tests, window: int, place: int, width: int, columns: list[str]):
    match_type = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes: TestSuffixes = tests.value
        for batch in batches:
            data, offsets = flat_bytes(batch.column(place))
            n = batch.num_rows
            earlier = [batch.column(i).to_pylist() for i in range(width + 1, width + 4)] if batch.num_columns > width else [[[]] * n] * 3
            n_words = np.zeros(n, np.int64)
            hits, items, matches = (list(x) for x in earlier)
            for a, b in row_groups(offsets, GROUP_BYTES):
                low = offsets[a]
                words, bounds = hashed_words(data[low : offsets[b]], offsets[a : b + 1] - low, _INSIDE, _LOW)
                n_words[a:b] = np.diff(bounds)
                if not len(words) or not len(suffixes.starts):
                    continue
                which, places = _matches(words, bounds, suffixes, window)
                if not len(which):
                    continue
                which, places, lengths = _runs(which, places, suffixes)
                row = np.searchsorted(bounds, places, side="right") - 1
                for r in np.unique(row):
                    mine = row == r
                    start, size = places[mine] - bounds[r], lengths[mine]
                    old = hits[a + r]
                    hits[a + r] = _covered([*zip(old[0::2], old[1::2]), *zip(start.tolist(), (start + size).tolist())])
                    named = suffixes.named[which[mine]]
                    ids = suffixes.items[which[mine]]
                    items[a + r] = sorted({*items[a + r], *ids[named].tolist()})
                    matches[a + r] = matches[a + r] + [{"item_id": i if k else None, "start": s, "length": z} for i, k, s, z in zip(ids.tolist(), named.tolist(), start.tolist(), size.tolist())]
            added = [pa.array(n_words), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64())), pa.array(matches, pa.list_(match_type))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], columns)

    return scan


def judge(matched: DataFrame, names: dict[str, str], share: int = SHARE):
    """Columns (n_hit, contaminated): contaminated if at least one word in ``share`` is hit."""
    hits = F.col(f"`{names['hits']}`")
    n_hit = F.aggregate(hits, F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).alias("sign")), lambda s, x: F.struct((s["sum"] + s["sign"] * x).alias("sum"), (-s["sign"]).alias("sign")), lambda s: s["sum"])
    return n_hit, (n_hit > 0) & (share * n_hit >= F.col(f"`{names['n_words']}`"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that are not contaminated.

    Null and empty texts have no words and stay; repeated rows and rows with null
    ids are judged each by itself. An empty benchmark removes nothing, and an
    empty table gives an empty result. Other columns pass, whatever their names.
    """
    matched, names = match_benchmark(docs, benchmark, window)
    _, bad = judge(matched, names, share)
    return matched.filter(~bad).drop(*names.values())
