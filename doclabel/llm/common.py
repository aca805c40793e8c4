"""What the operators share: unique document keys, flat byte views of Arrow texts, 64-bit hashes.

Tables may hold nulls, repeated rows and any further columns. ``with_key`` gives
every row a unique number that follows (doc_id, text), nulls last; operators
compare documents by it and never by position in a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclabel.operators.ordering import with_dense_id

WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet (names compare without case)."""
    used = {c.lower() for c in df.columns}
    while base.lower() in used:
        base = "_" + base
    return base


def with_key(docs: DataFrame, name: str, *columns: str, id_col: str = "doc_id", tie: str = "text") -> DataFrame:
    """Select ``id_col`` and ``columns`` with a unique long key ``name`` in the order of (id, tie), nulls last.

    Where no id is null or repeated, which one narrow aggregate tells, the key is
    the id itself and the texts stay where they are. Otherwise rows are numbered
    by a range sort, so that repeated rows count as documents of their own.
    """
    ids = docs.select(F.col(id_col).cast("bigint").alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    chosen = docs.select(id_col, *columns)
    if ids.filter("n > 1 OR i IS NULL").isEmpty():
        return chosen.withColumn(name, F.col(id_col).cast("bigint"))
    order = [F.asc_nulls_last(id_col)] + ([F.asc_nulls_last(tie)] if tie in columns else [])
    return with_dense_id(chosen, *order, name=name)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged; the fast built-in serves pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def drop_table(df: DataFrame) -> None:
    """Delete a staged table (all its files lie in one folder) once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        spark: SparkSession = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# --- flat bytes -------------------------------------------------------------------------


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without copying, and n + 1 offsets; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def row_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``limit`` bytes together; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


# --- hashes -----------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any byte range of a chunk, from one running sum modulo 2**64.

    Bytes count as random 64-bit numbers times powers of an odd base; ranges
    that differ in place or content differ but for chance.
    """

    LIMIT = 1 << 20
    _table = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    _up: np.ndarray | None = None
    _down: np.ndarray | None = None

    def __init__(self, data: np.ndarray):
        if len(data) > self.LIMIT:
            raise ValueError("chunk too long")
        if Rolling._up is None:
            base = int(mix(np.array([7], np.uint64))[0]) | 1
            Rolling._up = _powers(base, self.LIMIT + 1)
            Rolling._down = _powers(pow(base, -1, 1 << 64), self.LIMIT + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._table[data] * self._up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self._down[start]

    def grams(self, k: int) -> np.ndarray:
        """Hash of every k-byte string, by its start."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self._down[:n] if n > 0 else np.zeros(0, np.uint64)


# --- words ------------------------------------------------------------------------------


def word_table(white: bytes | None = None, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte after lower-casing A-Z) by byte value.

    ``white`` lists the bytes between words; None takes ASCII letters, digits and all non-ASCII bytes as word bytes.
    """
    values = np.arange(256)
    if white is None:
        inside = (values >= 0x80) | ((values >= 0x30) & (values <= 0x39)) | ((values >= 0x41) & (values <= 0x5A)) | ((values >= 0x61) & (values <= 0x7A))
    else:
        inside = ~np.isin(values, list(white))
    low = values.copy()
    if lower:
        low[0x41:0x5B] += 32
    return inside, low.astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and for each row the number of words before it (n + 1 values).

    Rows border on each other in ``data``; a word never crosses a row's border.
    """
    is_word = inside[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = len(data) > 0 and is_word[0], len(data) > 0 and is_word[-1]
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:-1])
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    cut = np.unique(borders[is_word[borders] & is_word[borders - 1]]) if len(borders) else borders
    marks = np.flatnonzero(edge)
    starts, ends = marks[0::2], marks[1::2]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def segments(data: np.ndarray, offsets: np.ndarray, limit: int, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Cut rows into chunks of at most ``limit`` bytes: (bytes, offsets in them, row numbers, first byte within its row).

    A row longer than ``limit`` comes in pieces of its own, which share ``overlap`` bytes; otherwise the last value is 0.
    """
    for start, end in row_groups(offsets, limit):
        low, high = offsets[start], offsets[end]
        if high - low <= limit:
            yield data[low:high], offsets[start : end + 1] - low, np.arange(start, end), 0
            continue
        at = low
        while True:
            stop = min(at + limit, high)
            yield data[at:stop], np.array([0, stop - at]), np.array([start]), int(at - low)
            if stop == high:
                break
            at = stop - overlap


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges come in order, do not overlap, and may lie in data of any length."""
    if len(data) <= Rolling.LIMIT:
        return mix(Rolling(data).ranges(starts, ends)) if len(starts) else np.zeros(0, np.uint64)
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + Rolling.LIMIT, side="right")))
        low, high = starts[at], ends[stop - 1]
        if high - low > Rolling.LIMIT:  # one huge range: a hash of its pieces' hashes, and no shorter range can equal it
            edges = np.append(np.arange(low, high, Rolling.LIMIT), high)
            total = np.ones(1, np.uint64)
            for a, b in zip(edges[:-1], edges[1:]):
                total = mix(total * _BASE + Rolling(data[a:b]).ranges(np.array([0]), np.array([b - a])))
            out[at] = total[0]
        else:
            out[at:stop] = mix(Rolling(data[low:high]).ranges(starts[at:stop] - low, ends[at:stop] - low))
        at = stop
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of some rows, and for each row the number of words before it (n + 1 values)."""
    starts, ends, bounds = word_spans(data, offsets, inside)
    return range_hashes(low[data], starts, ends), bounds
