"""Token counts of whole texts; huge ones are encoded in overlapping chunks and spliced.

A byte-level BPE splits a text into pre-tokens from left to right and merges
bytes within each. The splitting pattern never looks back and looks ahead a few
characters only. So, once a chunk starts at a true boundary, all its boundaries
that keep ``MARGIN`` characters from its end are boundaries of the whole text;
and if the next chunk, which may start anywhere, has a boundary at one of them,
it is right from there on. That common boundary is where two chunks are spliced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from doclabel.session import ship_package

CHUNK, OVERLAP, MARGIN = 1 << 16, 512, 64
MEMO = 600_000
# Fixed value: the splitting pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern with the letters, digits and spaces of the Latin blocks spelled out, for the faster standard matcher (agreement is tested).
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
NOT_LATIN = "[^\x00-ʯ‐-‧‰-⁞]"
# Blocks whose character classes agree between the two regular expression libraries (tested); other texts are split by the tokenizer itself.
NOT_AGREED = "[^\x00-ԯ‐-‧‰-⁞₠-₿ぁ-ヿ一-龥가-힣]"


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes visible Latin-1 characters as they are and numbers the other bytes from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter(dict):
    """Counts tokens; remembers the number of tokens of the pre-tokens it has met."""

    def __init__(self, definition: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        split = self.tokenizer.pre_tokenizer
        if not isinstance(split, pre_tokenizers.ByteLevel) or split.add_prefix_space or not split.use_regex or self.tokenizer.normalizer is not None:
            raise ValueError("a byte-level vocabulary without normaliser is needed")
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added) or any(len(t.content) >= MARGIN for t in added):
            raise ValueError("added tokens must be plain strings")
        self.specials = {t.content: 1 for t in added}  # no other pre-token equals one of these strings
        self.update(self.specials)
        self.special = regex.compile("|".join(regex.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) or r"(?!)")
        self.latin, self.not_latin = re.compile(LATIN_PATTERN), regex.compile(NOT_LATIN)
        self.pattern, self.not_agreed = regex.compile(PATTERN), regex.compile(NOT_AGREED)
        self.alphabet = _byte_alphabet()

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
            self.update(self.specials)
        count = len(self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet)))
        if len(piece) <= 64:
            self[piece] = count
        return count

    def _split(self, text: str) -> list[str]:
        if self.not_latin.search(text) is None:
            return self.latin.findall(text)
        if self.not_agreed.search(text) is None:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens; joined they give the text."""
        out, at = [], 0
        for found in self.special.finditer(text):
            out += self._split(text[at : found.start()])
            out.append(found.group())
            at = found.end()
        return out + self._split(text[at:]) if at else self._split(text)

    def tokens(self, pieces: list[str]) -> int:
        return sum(map(self.__getitem__, pieces))

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of the whole text, with pieces of no more than about ``chunk`` characters in hand."""
        if len(text) <= chunk:
            return self.tokens(self.pieces(text))
        total, start, end = 0, 0, chunk  # a chunk's start is a true boundary
        current = self.pieces(text[start:end])
        while end < len(text):
            width = overlap
            while True:
                begin = max(start, end - width)
                following = self.pieces(text[begin : begin + max(chunk, 2 * width)])
                at = self._common(current, start, following, begin, end - MARGIN)
                if at is not None:
                    break
                if begin > start:
                    width *= 2  # no proven boundary in the overlap: widen it
                else:  # the whole chunk has none: lengthen it
                    end = min(len(text), start + 2 * (end - start))
                    current = self.pieces(text[start:end])
                    if end == len(text):
                        return total + self.tokens(current)
            total += self._until(current, start, at)
            start, end = at, min(len(text), begin + max(chunk, 2 * width))
            current = self._after(following, begin, at)
        return total + self.tokens(current)

    @staticmethod
    def _boundaries(pieces: list[str], start: int) -> set[int]:
        return set(accumulate(map(len, pieces), initial=start))

    def _common(self, current, start, following, begin, last) -> int | None:
        """First boundary after ``start`` that both chunks have, in the overlap and not later than ``last``."""
        ours = self._boundaries(current, start)
        theirs = self._boundaries(following, begin) if begin > start else set()
        return min((x for x in ours & theirs if max(start, begin) < x <= last), default=None)

    def _until(self, pieces, start, at) -> int:
        n = next(i for i, x in enumerate(accumulate(map(len, pieces), initial=start)) if x == at)
        return self.tokens(pieces[:n])

    @staticmethod
    def _after(pieces, start, at) -> list[str]:
        n = next(i for i, x in enumerate(accumulate(map(len, pieces), initial=start)) if x == at)
        return pieces[n:]


_counters: dict[int, Counter] = {}


def _counter(definition: str) -> Counter:
    """One counter per worker and vocabulary: its memory serves all tasks of the worker."""
    known = hash(definition)
    if known not in _counters:
        _counters[known] = Counter(definition)
    return _counters[known]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``vocabulary`` is the path of a byte-level BPE of the tokenizers library. The
    driver reads it; tasks get it as a broadcast of the file's size. Counts are
    those of ``encode(text, add_special_tokens=False)``: strings of added tokens
    inside a text are one token each, as the library does by default.

    Null or empty text: no bytes, no tokens. Nulls or repeats of doc_id: every
    row is counted by itself. An empty table gives an empty result. Other columns
    are ignored, whatever their names. No shuffle.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(definition.value)
        for batch in batches:
            counts = [counter.count(text.as_py() or "", chunk, overlap) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    out = rows.mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
