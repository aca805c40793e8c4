"""Keyed tables sent to the rows: word lists are looked up where they are.

A text's words are looked up in a table with one row per key, such as a
vocabulary. The table is frozen into Arrow arrays in the order of the keys'
hashes, sent to the executors and searched by the distinct words of some hundred
texts at a time; what it finds is compared with the words themselves. The order
is made once, so a look does not take longer because the table is large. No token
becomes a row and no text is shuffled, however frequent its words are.

The size is measured first. A table beyond the bound is split by a hash of the
key into blocks within it. A task holds some megabytes of texts, with their
distinct words, and the blocks visit these one after another, so that one block is
in memory at a time. Texts are read once and never written, however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclabel.operators import lookup
from doclabel.session import ship_package

# Texts that a task unfolds at a time, and bytes of words that it holds while several blocks visit them.
ROWS, HELD_BYTES = 512, 32 << 20
# Bytes of full rows that a task multiplies at a time.
DENSE_BYTES = 32 << 20


# Bytes of words that are hashed at a time.
HASH_BYTES = 1 << 18
_FACTOR = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided by
_BYTES = np.random.default_rng(0).integers(1, 1 << 64, 256, np.uint64)  # what a byte stands for


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` + 1 powers of the factor, and of its inverse, modulo 2^64."""
    both = (_FACTOR, pow(_FACTOR, -1, 1 << 64))
    return tuple(np.append(np.uint64(1), np.cumprod(np.full(n, f, np.uint64))) for f in both)


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word (null: as the empty one): a polynomial of its bytes, read off running sums."""
    _, places, content = words.buffers()
    wide = pa.types.is_large_string(words.type)
    ends = np.frombuffer(places, np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    content = np.frombuffer(content or b"", np.uint8)
    hashes, start = np.empty(len(words), np.uint64), 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + HASH_BYTES, side="right")) - 1)
        part, at = content[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        up, down = _powers(max(HASH_BYTES, len(part)))
        sums = np.append(np.uint64(0), np.cumsum(_BYTES[part] * up[: len(part)]))
        hashes[start:stop] = (sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]]
        start = stop
    return hashes


@dataclass
class Block:
    """Keys in one piece, in the order of their hashes, with the columns that belong to them."""

    keys: pa.Array
    hashes: np.ndarray
    columns: dict[str, pa.Array]

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        """The rows of a table with a ``key``, but for a null key."""
        arrays = {c: _one(table.column(c)) for c in table.column_names}
        keys = arrays["key"]
        hashes = hashes_of(keys) if len(keys) else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        order = pa.array(order[keys.is_valid().to_numpy(zero_copy_only=False)[order]])
        return cls(arrays.pop("key").take(order), hashes[order.to_numpy()], {c: a.take(order) for c, a in arrays.items()})

    def places(self, items: pa.Array) -> np.ndarray:
        """Place of every item among the keys, -1 for unknown and null ones."""
        asked = Asked(items)
        return asked.each(self.found(asked), -1)

    def found(self, asked: Asked) -> np.ndarray:
        """The same for the distinct words."""
        words, hashes = asked.words, asked.hashes
        found = np.full(len(words), -1)
        if not len(words) or not len(self.keys):
            return found
        at = np.empty(len(words), np.int64)
        at[asked.order] = np.searchsorted(self.hashes, hashes[asked.order])  # neighbours are searched one after another
        left = np.arange(len(words))
        while True:
            left = left[at[left] < len(self.hashes)]
            left = left[self.hashes[at[left]] == hashes[left]]
            if not len(left):
                return found
            same = pc.equal(words.take(pa.array(left)), self.keys.take(pa.array(at[left])).cast(words.type)).to_numpy(zero_copy_only=False)
            found[left[same]] = at[left[same]]
            left = left[~same]  # another key of the same hash may follow
            at[left] += 1


class Asked:
    """Words to be looked up: the distinct ones, hashed once for all blocks, and where each stands."""

    def __init__(self, items: pa.Array):
        coded = items.dictionary_encode()
        self.words = coded.dictionary
        self.codes = coded.indices.fill_null(len(self.words)).to_numpy(zero_copy_only=False)
        self.hashes = hashes_of(self.words) if len(self.words) else np.empty(0, np.uint64)
        self.order = np.argsort(self.hashes)

    def each(self, values: np.ndarray, nothing) -> np.ndarray:
        """For every item the value of its word, ``nothing`` for a null."""
        return np.append(values, np.array([nothing], values.dtype))[self.codes]


@dataclass
class Sent:
    """Blocks of a keyed table that stay with the executors, for rows that come in parts, such as a stream's."""

    blocks: list[Broadcast[Block]]


def sent_once(keyed: DataFrame, size: int | None = None) -> Sent:
    """All blocks of a keyed table, sent. One after another passes the driver."""
    size = lookup.measured_bytes(keyed) if size is None else size
    n = max(1, -(-size // lookup.BROADCAST_BYTES))
    blocks = []
    for number in range(n):
        part = keyed if n == 1 else keyed.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == number)
        table = part.toArrow().combine_chunks()  # its size was measured
        blocks.append(keyed.sparkSession.sparkContext.broadcast(Block.of(table)))
    return Sent(blocks)


# Some rows, the words of a list column in one array, offsets of the rows.
Part = tuple[pa.RecordBatch, pa.Array, np.ndarray]


class Look:
    """What is asked for some rows: every block is shown to it, then it tells the rows."""

    def __init__(self, rows: pa.RecordBatch, words: pa.Array, offsets: np.ndarray):
        self.rows, self.offsets, self.asked = rows, offsets, Asked(words)

    def see(self, block: Block) -> None:
        raise NotImplementedError

    def tell(self) -> pa.RecordBatch:
        raise NotImplementedError


def visited(df: DataFrame, keyed: DataFrame | Sent, look: Callable[[pa.RecordBatch, pa.Array, np.ndarray], Look], place: int, schema: T.StructType, size: int | None = None) -> DataFrame:
    """What the looks tell of ``df`` after every block of ``keyed`` (unique ``key`` and further columns) was shown to them.

    ``place`` is the column of the word lists, ``size`` the measured size of ``keyed``, if it is known.
    """
    ship_package(df.sparkSession)
    blocks = (keyed if isinstance(keyed, Sent) else sent_once(keyed, size)).blocks

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _held(unfolded(batches, place), HELD_BYTES if len(blocks) > 1 else 0):
            looks = [look(*part) for part in parts]
            for sent in blocks:
                block = sent.value
                for one in looks:
                    one.see(block)
                if len(blocks) > 1:
                    del block
                    sent.__dict__.pop("_value", None)  # the worker reads it again from its file
            for one in looks:
                yield one.tell()

    return df.mapInArrow(visit, schema)


def _held(parts: Iterator[Part], most: int) -> Iterator[list[Part]]:
    """Parts in a row with ``most`` bytes of words, or just above."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part[1].nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _one(column: pa.ChunkedArray) -> pa.Array:
    chunks = column.combine_chunks()
    return chunks if isinstance(chunks, pa.Array) else pa.concat_arrays(chunks.chunks)


def unfolded(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """(rows, the words of the list column at ``place`` in one array, n + 1 offsets); a null list is empty."""
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            rows = batch.slice(start, ROWS)
            sizes = pc.fill_null(pc.list_value_length(rows.column(place)), 0).to_numpy(zero_copy_only=False)
            yield rows, rows.column(place).flatten(), np.append(0, np.cumsum(sizes, dtype=np.int64))


def lists_of(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def last_words(offsets: np.ndarray) -> np.ndarray:
    """Places of the last word of every text that has any."""
    return offsets[1:][np.diff(offsets) > 0] - 1


def _phrases(words: pa.Array, offsets: np.ndarray) -> pa.Array:
    """The phrase ``word_next`` that each word opens, null for the last word of a text."""
    if not len(words):
        return words
    last = np.zeros(len(words), bool)
    last[last_words(offsets)] = True
    after = pa.concat_arrays([words.slice(1), pa.nulls(1, words.type)])
    return pc.if_else(pa.array(last), pa.scalar(None, words.type), pc.binary_join_element_wise(words, after, "_"))


class _Ids(Look):
    """The id of every word, -1 for unknown ones."""

    def __init__(self, rows: pa.RecordBatch, words: pa.Array, offsets: np.ndarray):
        super().__init__(rows, words, offsets)
        self.ids = np.full(len(self.asked.words), -1, np.int64)

    def see(self, block: Block) -> None:
        self.ids = np.maximum(self.ids, np.append(block.columns["id"].to_numpy(), -1)[block.found(self.asked)])  # place -1: no id


def _with_id(keyed: DataFrame) -> DataFrame:
    return keyed.select("key", F.col("id").cast("bigint").alias("id"))


def with_ids(df: DataFrame, keyed: DataFrame, words: str, name: str) -> DataFrame:
    """Add the new column ``name``: the ``id`` (0 or more) of every word of the list, -1 for words not in the table."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])

    class Added(_Ids):
        def tell(self) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*self.rows.columns, lists_of(pa.array(self.asked.each(self.ids, -1)), self.offsets)], schema.names)

    return visited(df, _with_id(keyed), Added, df.columns.index(words), schema)


def known_ids(df: DataFrame, keyed: DataFrame, words: str) -> DataFrame:
    """Replace each word list by the ``id`` (0 or more) of its words that are keys of the table, in order. Null lists become empty ones."""
    place = df.columns.index(words)
    schema = T.StructType([T.StructField(words, T.ArrayType(T.LongType())) if f.name == words else f for f in df.schema.fields])

    class Known(_Ids):
        def tell(self) -> pa.RecordBatch:
            ids, columns = self.asked.each(self.ids, -1), self.rows.columns
            columns[place] = lists_of(pa.array(ids[ids >= 0]), np.append(0, np.cumsum(ids >= 0))[self.offsets])
            return pa.RecordBatch.from_arrays(columns, schema.names)

    return visited(df, _with_id(keyed), Known, place, schema)


_WORD, _PHRASE = 1, 2


def rewritten(df: DataFrame, keyed: DataFrame | Sent, words: str, keep_last: bool = False) -> DataFrame:
    """Replace each word list by its words and phrases that are keys of the table, in order.

    Every word is followed by the phrase that it opens. The last word of a text
    stands for itself only with ``keep_last``. Null lists become empty ones.
    """
    place, schema, n, flags = df.columns.index(words), df.schema, len(df.columns), "_flags"
    while flags in df.columns:
        flags = "_" + flags
    sent = keyed if isinstance(keyed, Sent) else sent_once(keyed.select("key"))
    several = len(sent.blocks) > 1

    def with_words(rows: pa.RecordBatch, flat: pa.Array, phrases: pa.Array, found: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        columns = rows.columns[:n]
        columns[place] = _chosen(flat, phrases, found, offsets, keep_last)
        return pa.RecordBatch.from_arrays(columns, schema.names)

    class Chosen(Look):
        def __init__(self, rows: pa.RecordBatch, flat: pa.Array, offsets: np.ndarray):
            super().__init__(rows, flat, offsets)
            phrases = _phrases(flat, offsets)
            self.flat, self.phrases, self.both = flat, None if several else phrases, [self.asked, Asked(phrases)]
            self.known = [np.zeros(len(asked.words), bool) for asked in self.both]

        def see(self, block: Block) -> None:
            for asked, known in zip(self.both, self.known):
                known |= block.found(asked) >= 0

        def tell(self) -> pa.RecordBatch:
            word, phrase = (asked.each(known, False) for asked, known in zip(self.both, self.known))
            found = (np.where(word, _WORD, 0) | np.where(phrase, _PHRASE, 0)).astype(np.int8)
            if several:
                return pa.RecordBatch.from_arrays([*self.rows.columns, lists_of(pa.array(found), self.offsets)], [*schema.names, flags])
            return with_words(self.rows, self.flat, self.phrases, found, self.offsets)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offsets in unfolded(batches, place):
            yield with_words(rows, flat, _phrases(flat, offsets), rows.column(n).flatten().to_numpy().copy(), offsets)

    if not several:
        return visited(df, sent, Chosen, place, schema)
    # While several blocks visit them, texts are held with flags of one byte a word and without their phrases.
    flagged = visited(df, sent, Chosen, place, T.StructType([*schema.fields, T.StructField(flags, T.ArrayType(T.ByteType()))]))
    return flagged.mapInArrow(choose, schema)


def kept_words(df: DataFrame, keyed: DataFrame, words: str) -> DataFrame:
    """Replace each word list by its words that are keys of the table, in order. Null lists become empty ones."""
    place, schema = df.columns.index(words), df.schema

    class Kept(Look):
        def __init__(self, rows: pa.RecordBatch, flat: pa.Array, offsets: np.ndarray):
            super().__init__(rows, flat, offsets)
            self.flat, self.known = flat, np.zeros(len(self.asked.words), bool)

        def see(self, block: Block) -> None:
            self.known |= block.found(self.asked) >= 0

        def tell(self) -> pa.RecordBatch:
            known, columns = self.asked.each(self.known, False), self.rows.columns
            columns[place] = lists_of(self.flat.filter(pa.array(known)), np.append(0, np.cumsum(known))[self.offsets])
            return pa.RecordBatch.from_arrays(columns, schema.names)

    return visited(df, keyed.select("key"), Kept, place, schema)


def _chosen(words: pa.Array, phrases: pa.Array, found: np.ndarray, offsets: np.ndarray, keep_last: bool) -> pa.ListArray:
    """Word, phrase, word, phrase, ... of each text, as far as they were found."""
    if not keep_last:
        found[last_words(offsets)] &= ~_WORD
    wanted = np.empty(2 * len(found), bool)
    wanted[0::2], wanted[1::2] = found & _WORD > 0, found & _PHRASE > 0
    at = np.flatnonzero(wanted)
    values = pa.concat_arrays([words, phrases]).take(pa.array((at >> 1) + (at & 1) * len(found)))
    return lists_of(values, np.append(0, np.cumsum(wanted))[2 * offsets])


class _Counts(_Ids):
    """How often each row has each of its words: (row, word, count), and the ids of the words."""

    def __init__(self, rows: pa.RecordBatch, words: pa.Array, offsets: np.ndarray):
        super().__init__(rows, words, offsets)
        self.row, self.word, self.n = _pair_counts(self.asked.codes, offsets, len(self.asked.words))


def _pair_counts(codes: np.ndarray, offsets: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, count) of the words of each row, but for nulls (``n_words``)."""
    rows, width = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), max(n_words, 1)
    valid = codes < n_words
    pairs, n = np.unique(rows[valid] * width + codes[valid], return_counts=True)
    return pairs // width, pairs % width, n


def counted(df: DataFrame, keyed: DataFrame, id_col: str, words: str) -> DataFrame:
    """Sparse count vectors ``(id_col, id, n)`` of the words of each list that are keys of the table."""
    schema = T.StructType([df.schema[id_col], T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])

    class Counted(_Counts):
        def tell(self) -> pa.RecordBatch:
            ids = self.ids[self.word]
            known = ids >= 0
            return pa.RecordBatch.from_arrays([self.rows.column(0).take(pa.array(self.row[known])), pa.array(ids[known]), pa.array(self.n[known])], schema.names)

    return visited(df.select(id_col, words), _with_id(keyed), Counted, 1, schema)


def with_counts(df: DataFrame, keyed: DataFrame, words: str, n_keys: int, name: str) -> DataFrame:
    """Add ``name``: how often each of the ``n_keys`` keys (``id`` from 0) is in the list."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    class Counted(_Counts):
        def tell(self) -> pa.RecordBatch:
            ids = self.ids[self.word]
            known, n = ids >= 0, len(self.rows)
            counts = np.bincount(self.row[known] * n_keys + ids[known], self.n[known], n * n_keys).astype(np.int32)
            return pa.RecordBatch.from_arrays([*self.rows.columns, lists_of(pa.array(counts), np.arange(n + 1) * n_keys)], schema.names)

    return visited(df, _with_id(keyed), Counted, df.columns.index(words), schema)


def added_gains(df: DataFrame, keyed: DataFrame | Sent, id_col: str, words: str, n_classes: int, name: str = "sums", size: int | None = None, log: bool = False) -> DataFrame:
    """``(id_col, name)``: per list the number of known words, then for each class the gains of its words added up.

    ``keyed`` has sparse rows: the classes of a key (``labels``, from 0) and their
    ``gains``, with ``log`` counts n that gain log(n + 1). A block of lists times a
    block of keys is one sparse product.
    """
    width = n_classes + 1
    schema = T.StructType([df.schema[id_col], T.StructField(name, T.ArrayType(T.DoubleType()))])

    class Added(Look):
        def __init__(self, rows: pa.RecordBatch, flat: pa.Array, offsets: np.ndarray):
            super().__init__(rows, flat, offsets)
            self.row, self.word, self.n = _pair_counts(self.asked.codes, offsets, len(self.asked.words))
            self.sums = np.zeros(len(rows) * width)

        def see(self, block: Block) -> None:
            place = block.found(self.asked)  # of every distinct word
            known = place[self.word] >= 0
            self.sums[::width] += np.bincount(self.row[known], self.n[known], len(self.rows))
            starts = block.columns["labels"].offsets.to_numpy().astype(np.int64)
            labels, gains = (block.columns[c].values.to_numpy() for c in ("labels", "gains"))
            sizes = np.where(place >= 0, starts[place + 1] - starts[place], 0)

            def cells(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """(which of the words, class, gain) of their sparse rows."""
                of = np.repeat(np.arange(len(words)), sizes[words])
                at = np.arange(len(of)) + np.repeat(starts[place[words]] - np.cumsum(sizes[words]) + sizes[words], sizes[words])
                return of, labels[at], np.log(gains[at] + 1.0) if log else gains[at]

            # Words of many classes are met as full rows, some thousand pairs at a time, the others cell by cell.
            wide = np.flatnonzero(sizes * 8 >= n_classes)[: DENSE_BYTES // (8 * n_classes)]
            line = np.full(len(place), -1)
            line[wide] = np.arange(len(wide))
            of, label, gain = cells(wide)
            full = np.bincount(of * n_classes + label, gain, len(wide) * n_classes).reshape(len(wide), n_classes)
            at = line[self.word]
            row, at, n = self.row[at >= 0], at[at >= 0], self.n[at >= 0]
            table, step = self.sums.reshape(-1, width), max(1, DENSE_BYTES // (64 * n_classes))
            for start in range(0, len(row), step):
                own = slice(start, start + step)
                firsts = np.flatnonzero(np.append(True, np.diff(row[own]) > 0))
                table[row[own][firsts], 1:] += np.add.reduceat(full[at[own]] * n[own, None], firsts, axis=0)
            few = known & (line[self.word] < 0)
            row, n = self.row[few], self.n[few]
            of, label, gain = cells(self.word[few])
            self.sums += np.bincount(row[of] * width + 1 + label, n[of] * gain, len(self.sums))

        def tell(self) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([self.rows.column(0), lists_of(pa.array(self.sums), np.arange(len(self.rows) + 1) * width)], schema.names)

    return visited(df.select(id_col, words), keyed if isinstance(keyed, Sent) else keyed.select("key", "labels", "gains"), Added, 1, schema, size)
