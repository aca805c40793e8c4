"""Byte-level BPE: encoding by a segment tree of pair ranks, and decoding.

A text is cut by the vocabulary's pattern; each piece is merged by itself. The
leaves of a segment tree over the piece's bytes hold the rank of the pair that
starts there, and every inner node the least (rank, place) below it. The root is
thus the leftmost pair of least rank; a merge changes three leaves, each in
logarithmic time, so a piece of n bytes takes n log n steps however long it is.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclabel.session import ship_package

MEMO, ROWS = 200_000, 128
# Pieces of up to so many characters are remembered; those of up to so many bytes are merged many at a time.
SHORT, TOGETHER = 64, 4096
# Characters, or pieces, in hand at a time.
GROUP = 1 << 16
# Texts are split by classes of no more code points than they need: the matcher tests small ones faster.
TIERS = (0x100, 0x10000, 0x110000)
_PLACE = 40
_NONE = 1 << 62


def read_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Ranks from a rank file: a line per token, its bytes in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece; all single bytes must have a rank."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    width = 1 << max(0, (n - 2).bit_length())
    tree = array("q", [_NONE]) * (2 * width)
    following, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))  # where the token that starts here ends; the one before
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank << _PLACE | i
    for at in range(width - 1, 0, -1):
        left, right = tree[2 * at], tree[2 * at + 1]
        tree[at] = left if left < right else right

    def put(place: int, end: int) -> None:
        """The pair whose bytes are piece[place:end] now starts at ``place``; 0: none does."""
        rank = get(piece[place:end]) if end else None
        at = width + place
        tree[at] = _NONE if rank is None else rank << _PLACE | place
        while at > 1:
            low, other = tree[at], tree[at ^ 1]
            if other < low:
                low = other
            at >>= 1
            if tree[at] == low:
                return
            tree[at] = low

    while (least := tree[1]) != _NONE:
        first = least & ((1 << _PLACE) - 1)
        second = following[first]
        third = following[second]
        following[first] = third
        if second < n - 1:
            put(second, 0)
        if third < n:
            before[third] = first
            put(first, following[third])
        else:
            put(first, 0)
        previous = before[first]
        if previous >= 0:
            put(previous, third)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : following[at]]])
        at = following[at]
    return out


def spelled_out(pattern: str, below: int = 0x110000) -> str:
    r"""For texts of code points under ``below``: the pattern for the standard matcher, with the classes \p{L}, \p{N}, \s and \S listed as the tiktoken library knows them.

    Libraries follow different versions of Unicode. Which code points a class
    has is asked from the library itself: it encodes what the class matches of all code points.
    """
    points = "".join(chr(c) for c in range(below) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
        listed = _ranges(sorted(map(ord, set(probe.decode(probe.encode_ordinary(points))))))
        inside = re.compile(r"(\[\^?(?:[^\]]*))" + re.escape(name))
        while inside.search(pattern):
            pattern = inside.sub(lambda m: m[1] + listed, pattern, count=1)
        pattern = pattern.replace(name, f"[{listed}]")
        if name == r"\s":
            pattern = pattern.replace(r"\S", f"[^{listed}]")
    return pattern


def _ranges(points: list[int]) -> str:
    """Sorted code points as the inside of a character class."""
    at = np.array(points)
    starts = np.flatnonzero(np.append(True, np.diff(at) > 1))
    ends = np.append(starts[1:], len(at)) - 1
    return "".join(f"\\U{at[a]:08x}-\\U{at[b]:08x}" for a, b in zip(starts, ends))


class PairTable:
    """Ranks of the tokens that two neighbouring tokens make, by their ids, for whole arrays at once."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        parts = [(get(t[:k]), get(t[k:]), rank) for t, rank in ranks.items() for k in range(1, len(t))]
        found = np.array([p for p in parts if p[0] is not None and p[1] is not None] or np.zeros((0, 3)), np.int64)
        keys = found[:, 0] << 32 | found[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], 1 << 62), np.append(found[order, 2], 0)
        self.single = np.array([ranks[bytes([b])] for b in range(256)])

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(rank, place) of the pairs as one number, _NONE where they make no token; a negative id is no token."""
        key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at] << _PLACE | place, _NONE)


def merge_pieces(pieces: list[bytes], table: PairTable) -> list[bytes]:
    """Packed ids of many pieces of about the same length: a segment tree for each, all taking a step at a time."""
    n, sizes = len(pieces), np.array([len(p) for p in pieces])
    width = 1 << int(sizes.max() - 1).bit_length()
    depth = width.bit_length() - 1
    inside = np.arange(width) < sizes[:, None]
    ids = np.full((n, width + 1), -1, np.int64)  # one more place: the end of a piece that fills all others
    ids[:, :width][inside] = table.single[np.frombuffer(b"".join(pieces), np.uint8)]
    following = np.tile(np.arange(1, width + 2), (n, 1))
    before = np.tile(np.arange(-1, width), (n, 1))
    tree = np.full((n, 2 * width), _NONE, np.int64)
    tree[:, width:] = table.leaves(ids[:, :-1], ids[:, 1:], np.broadcast_to(np.arange(width), (n, width)))
    for level in range(depth - 1, -1, -1):
        low = 1 << level
        tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
    rows = np.flatnonzero(tree[:, 1] != _NONE) if width > 1 else np.zeros(0, np.int64)
    while len(rows):
        least = tree[rows, 1]
        first = least & ((1 << _PLACE) - 1)
        second = following[rows, first]
        third = following[rows, second]
        ids[rows, first], ids[rows, second] = least >> _PLACE, -1
        inside[rows, second] = False
        following[rows, first] = third
        before[rows, third] = first
        previous = before[rows, first]
        some = previous >= 0
        tree[rows, width + second] = _NONE
        tree[rows, width + first] = table.leaves(ids[rows, first], ids[rows, third], first)
        tree[rows[some], width + previous[some]] = table.leaves(ids[rows[some], previous[some]], ids[rows[some], first[some]], previous[some])
        for at in (second, first, np.where(some, previous, first)):
            at = at + width
            for _ in range(depth):
                at >>= 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
        rows = rows[tree[rows, 1] != _NONE]
    packed = ids[:, :width][inside].astype("<u4").tobytes()
    ends = np.cumsum(inside.sum(1)) * 4
    return [packed[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]


class Encoder:
    """Encodes texts; remembers the packed ids (little-endian 32-bit) of the short pieces it has met."""

    def __init__(self, vocabulary: bytes, patterns: tuple[str, ...]):
        self.ranks = read_ranks(vocabulary)
        if not all(bytes([b]) in self.ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.pairs, self.known = PairTable(self.ranks), {}
        self.splits = [(re.compile(f"[\\0-\\U{below - 1:08x}]*").fullmatch, re.compile(p)) for below, p in zip(TIERS, patterns)]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, at most GROUP of them in one list."""
        split = next(p for fits, p in self.splits if fits(text))
        if len(text) <= GROUP:
            yield split.findall(text)
            return
        found = (m.group() for m in split.finditer(text))
        while part := list(islice(found, GROUP)):
            yield part

    def learn(self, pieces: set[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(data) > TOGETHER:
                self.known[piece] = np.array(merge_piece(data, self.ranks), "<u4").tobytes()
            else:
                by_width.setdefault((len(data) - 1).bit_length(), []).append((piece, data))
        for bits, group in by_width.items():
            step = max(1, (1 << 14) >> bits)
            for start in range(0, len(group), step):
                part = group[start : start + step]
                self.known.update(zip([p for p, _ in part], merge_pieces([d for _, d in part], self.pairs)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; about GROUP characters are in hand at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for row, text in enumerate(texts):
            for part in self.pieces(text):
                held.append((row, part))
                size += len(part) + sum(map(len, part)) // 8
                if size >= GROUP:
                    self._encode(held, out)
                    held, size = [], 0
        self._encode(held, out)
        return [b"".join(parts) for parts in out]

    def _encode(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self.known) >= MEMO:
            self.known.clear()
        met = set().union(*(part for _, part in held))
        self.learn(met.difference(self.known))
        for row, part in held:
            out[row].append(b"".join(map(self.known.__getitem__, part)))
        for piece in met:
            if len(piece) > SHORT:
                del self.known[piece]


_encoders: dict[int, Encoder] = {}
_tables: dict[int, list[bytes]] = {}


def _encoder(vocabulary: bytes, patterns: tuple[str, ...]) -> Encoder:
    """One encoder per worker and vocabulary: its memory serves all tasks of the worker."""
    known = hash((vocabulary, patterns))
    if known not in _encoders:
        _encoders[known] = Encoder(vocabulary, patterns)
    return _encoders[known]


def _table(vocabulary: bytes) -> list[bytes]:
    """Token bytes by id."""
    known = hash(vocabulary)
    if known not in _tables:
        ranks = read_ranks(vocabulary)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _tables[known] = table
    return _tables[known]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWS rows at a time: Python objects are made of a few texts only."""
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            yield batch.slice(start, ROWS)


def _shipped(df: DataFrame, vocabulary: str):
    """The file's bytes as a broadcast; the driver reads them."""
    ship_package(df.sparkSession)
    with open(vocabulary, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text: ``id_col``, n_tokens, ids (packed little-endian unsigned 32-bit integers).

    ``vocabulary`` is the path of a rank file, ``pattern`` cuts texts into pieces.
    Null or empty text: no ids. Nulls or repeats of ``id_col``: every row is
    encoded by itself. An empty table gives an empty result. Other columns are
    ignored, whatever their names. No shuffle; a task holds one Arrow batch and
    a bounded memory of pieces.
    """
    shipped = _shipped(docs, vocabulary)
    patterns = tuple(spelled_out(pattern, below) for below in TIERS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value, patterns)
        for batch in _slices(batches):
            packed = encoder.encode([text or "" for text in batch.column(1).to_pylist()])
            counts = pa.array([len(p) // 4 for p in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(packed, pa.binary())], [id_col, "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text)).mapInArrow(encoded, f"`{id_col}` bigint, n_tokens bigint, ids binary")


def decode_ids(encoded: DataFrame, vocabulary: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add ``name``, the bytes that the packed ``ids`` stand for; null ids decode to no bytes.

    All columns pass through; ``name`` must be a new one. An id without a token raises an error.
    """
    if name.lower() in (c.lower() for c in encoded.columns):
        raise ValueError(f"column {name!r} exists")
    shipped = _shipped(encoded, vocabulary)
    place = encoded.columns.index(ids)
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shipped.value)
        for batch in _slices(batches):
            texts = [b"".join(map(table.__getitem__, np.frombuffer(v.as_py() or b"", "<u4").tolist())) for v in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, name])

    return encoded.mapInArrow(decoded, schema)
