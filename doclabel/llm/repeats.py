"""Exact removal of repeated byte strings with a sparse, distributed suffix array.

A string of ``length`` bytes removes the places it covers if it also starts
earlier. Comparing all suffixes would move many times the input, so suffixes are
chosen by content first: each window of ``length`` bytes owns the least of its
``GRAM``-byte strings, and equal windows own it at the same place. These anchors
are the suffixes of the array, their gram the initial bucket.

* Anchors whose owned windows have equal bytes (one class) need no comparison:
  all but the first of the class are repeats.
* Buckets of several classes are refined: their windows are sorted by bucket
  pointers of later offsets, with updates reused at once (``buckets``).
* Very frequent grams are told by a bounded sample. Their anchors are dealt by
  class, not by gram, and refined further first: an anchor's windows fall into
  parts by how many grams of the window lie before the anchor, and a part's
  bucket is the anchor's bucket refined by those at all later and earlier offsets
  that the part's windows hold whole. Equal windows share part and bucket. Equal
  parts are one again, and the rest of a sub-bucket is refined as any other. A
  sub-bucket that is still large ends at its last refinement, whole windows.
  The sample steers the plan, not the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclabel.llm.buckets import refine
from doclabel.llm.common import Rolling, flat_bytes, mix, row_groups, segments
from doclabel.session import ship_package
from doclabel.staging import scratch_path, stage

LENGTH, GRAM = 100, 24
SAMPLE_DOCS, HOT_SHARE = 8192, 5000
BUCKET_ROWS = 50_000
DUPLICATE, REFINE, SPREAD = 1, 2, 3
_PLACE = np.uint64((1 << 20) - 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Anchors:
    """Anchors of some rows: row, first and last owned window and own place (bytes from the row's start), gram and class hashes."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    gram: np.ndarray
    context: np.ndarray

    @property
    def name(self) -> np.ndarray:
        """One number per class, the two low bits free."""
        return mix(self.gram ^ (self.context * _ODD)) & ~np.uint64(3)


def _anchors(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, base: int, length: int, gram: int) -> Anchors:
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)  # windows per row
    n, total = len(data), int(sizes.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    rolling = Rolling(data)
    grams = mix(rolling.grams(gram))
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
    owner = (least[start] & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])])
    tail = np.r_[head[1:], total] - 1
    first, last, at = start[head], start[tail], owner[head]
    spread = ((at - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64) + np.uint64(1)
    context = mix(rolling.ranges(first, last + length) ^ mix(spread))
    shift = base - offsets[row[head]]
    return Anchors(rows[row[head]], first + shift, last + shift, at + shift, grams[at], context)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[Anchors]:
    """Anchors of all rows, in chunks of bounded size; a long row comes in pieces that share ``length`` - 1 bytes."""
    for chunk, local, rows, base in segments(data, offsets, Rolling.LIMIT, length - 1):
        yield _anchors(chunk, local, rows, base, length, gram)


def _isin(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _of_batch(batch_texts: pa.Array, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, Anchors, np.ndarray, np.ndarray]:
    """Bytes, offsets, all anchors in order, a number for (row, class), and whether the class came earlier in the row."""
    data, offsets = flat_bytes(batch_texts)
    parts = list(anchors(data, offsets, length, gram)) or [_anchors(data[:0], np.zeros(1, np.int64), np.zeros(0, np.int64), 0, length, gram)]
    found = Anchors(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("row", "first", "last", "at", "gram", "context")))
    place = _in_row(found.name, found.row)
    order = np.argsort(place, kind="stable")
    again = np.zeros(len(order), bool)
    again[order[1:]] = place[order[1:]] == place[order[:-1]]
    return data, offsets, found, place, again


def _in_row(names: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return names ^ (mix(rows.astype(np.uint64) + np.uint64(1)) & ~np.uint64(3))


def emit_anchors(keyed: DataFrame, key: str, hot: np.ndarray, length: int, gram: int) -> DataFrame:
    """(q, c, d, hot): each class of each document once; of hot grams each class once per batch, with its least document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, found, _, again = _of_batch(batch.column(1), length, gram)
            keys = batch.column(0).to_numpy(zero_copy_only=False)[found.row]
            often = _isin(found.gram, hot)
            keep = ~again & ~often
            some = np.flatnonzero(often & ~again)
            some = some[np.lexsort((keys[some], found.name[some]))]
            some = some[np.r_[True, found.name[some][1:] != found.name[some][:-1]]] if len(some) else some
            chosen = np.concatenate([np.flatnonzero(keep), some])
            yield pa.RecordBatch.from_arrays([
                pa.array(found.gram[chosen].view(np.int64)), pa.array(found.context[chosen].view(np.int64)),
                pa.array(keys[chosen]), pa.array(often[chosen])], ["q", "c", "d", "hot"])

    return keyed.select(key, "text").mapInArrow(emit, "q bigint, c bigint, d bigint, hot boolean")


def hot_grams(keyed: DataFrame, key: str, length: int, gram: int) -> np.ndarray:
    """Grams with one in ``HOT_SHARE`` anchors of a sample of about ``SAMPLE_DOCS`` documents, or, by the sample, ``BUCKET_ROWS`` in all.

    A gram is seen 8 times at least, so the sample's anchors bound their number.
    """
    n = keyed.count()
    chosen = keyed if n <= SAMPLE_DOCS else keyed.filter(F.pmod(F.xxhash64(key, F.lit("hot")), F.lit(1 << 30)) < int((1 << 30) * SAMPLE_DOCS / n))
    seen = emit_anchors(chosen, key, np.zeros(0, np.uint64), length, gram).groupBy("q").agg(F.count("*").alias("n"))
    share = (n and seen.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    floor = max(8, min(share, BUCKET_ROWS * min(SAMPLE_DOCS, n) // max(n, 1)))
    return np.sort(np.array([r["q"] for r in seen.filter(F.col("n") >= floor).collect()], np.int64).view(np.uint64))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (q, c, d) in, (d, code) out: the class name with what is to happen to its anchor in document d.

    Buckets are looked at whole up to ``BUCKET_ROWS`` rows; a larger one is taken
    piece by piece, and the first of each class is refined by its parts.
    """

    def judged(q, c, d, hot, opened, big):
        new_q = np.r_[True, q[1:] != q[:-1]]
        new_c = new_q | np.r_[True, c[1:] != c[:-1]]
        if opened == (q[0], c[0]):
            new_c[0] = False
        bucket = np.cumsum(new_q) - 1
        classes = np.bincount(bucket, new_c)[bucket]
        spread = hot | (q == big if big is not None else False)
        code = np.where(new_c, np.where(spread, SPREAD, np.where(classes > 1, REFINE, 0)), np.where(hot, 0, DUPLICATE))
        keep = code > 0
        name = Anchors(d, d, d, d, q.view(np.uint64), c.view(np.uint64)).name[keep] | code[keep].astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(name.view(np.int64))], ["d", "code"])

    rest, opened, big = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        rest = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns)]
        q = rest[0]
        cut = int(np.flatnonzero(q != q[-1])[-1]) + 1 if q[0] != q[-1] else 0
        if cut:
            yield judged(*(x[:cut] for x in rest), opened, big)
            rest, opened = [x[cut:] for x in rest], None
            big = None if rest[0][0] != big else big
        if len(rest[0]) > BUCKET_ROWS:
            big = rest[0][-1]
            yield judged(*rest, opened, big)
            opened, rest = (rest[0][-1], rest[1][-1]), None
    if rest is not None and len(rest[0]):
        yield judged(*rest, opened, big)


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes covered by ranges sorted by (row, start)."""
    if not len(row):
        return row, start, end
    # Ends count on from row to row, so that a running maximum never reaches into the next row.
    lift = row * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    head = np.flatnonzero(np.r_[True, (start + lift)[1:] > reach[:-1]])
    head = np.unique(np.concatenate([head, np.flatnonzero(np.r_[True, row[1:] != row[:-1]])]))
    tail = np.r_[head[1:], len(row)] - 1
    return row[head], start[head], (reach - lift)[tail]


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    pieces, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        pieces.append(text[at:a])
        at = b
    return b"".join([*pieces, text[at:]])


_SPAN = pa.struct([("q", pa.int64()), ("first", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary())])
_STATE = "_key bigint, doc_id bigint, done boolean, body binary, n_bytes bigint, spans array<int>, ranges array<int>, refine array<struct<q: bigint, first: int, at: int, bytes: binary>>, spread array<struct<q: bigint, first: int, at: int, bytes: binary>>"


def apply_codes(rows: DataFrame, hot: np.ndarray, length: int, gram: int) -> DataFrame:
    """(_key, doc_id, text, codes) to settled documents, and to what is left to compare in the others."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            data, offsets, found, place, again = _of_batch(batch.column(2), length, gram)
            codes = batch.column(3)
            values = codes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(n), np.diff(codes.offsets.to_numpy()))
            known = _in_row(values & ~np.uint64(3), owner)
            order = np.argsort(known)
            known, what = known[order], (values & np.uint64(3)).astype(np.int64)[order]
            code = np.zeros(len(place), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, place), len(known) - 1)
                code = np.where(known[at] == place, what[at], 0)
            code[_isin(found.gram, hot) & (code == 0)] = DUPLICATE
            code[again] = DUPLICATE
            gone = np.flatnonzero(code == DUPLICATE)
            run, start, end = _merged(found.row[gone], found.first[gone], found.last[gone] + length)
            bounds = np.searchsorted(run, np.arange(n + 1))
            gone_bounds = np.searchsorted(found.row[gone], np.arange(n + 1))
            left = np.flatnonzero(code >= REFINE)
            left_bounds = np.searchsorted(found.row[left], np.arange(n + 1))
            whole = data.tobytes()
            done, body, spans, ranges, refine_, spread = [], [], [], [], [], []
            for r in range(n):
                text = whole[offsets[r] : offsets[r + 1]]
                mine = left[left_bounds[r] : left_bounds[r + 1]]
                x, y = bounds[r], bounds[r + 1]
                done.append(not len(mine))
                if not len(mine):
                    body.append(_cut(text, start[x:y], end[x:y]) if y > x else text)
                    spans.append(np.stack([start[x:y], end[x:y]], 1).ravel().astype(np.int32))
                    ranges.append([]), refine_.append([]), spread.append([])
                    continue
                body.append(text)
                spans.append([])
                g = gone[gone_bounds[r] : gone_bounds[r + 1]]
                ranges.append(np.stack([found.first[g], found.last[g]], 1).ravel().astype(np.int32))
                made = [(code[i], {"q": int(found.gram[i].view(np.int64)), "first": int(found.first[i]), "at": int(found.at[i]), "bytes": text[found.first[i] : found.last[i] + length]}) for i in mine]
                refine_.append([m for k, m in made if k == REFINE])
                spread.append([m for k, m in made if k == SPREAD])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(done, pa.bool_()), pa.array(body, pa.binary()), pa.array(np.diff(offsets)),
                pa.array(spans, pa.list_(pa.int32())), pa.array(ranges, pa.list_(pa.int32())), pa.array(refine_, pa.list_(_SPAN)), pa.array(spread, pa.list_(_SPAN))],
                ["_key", "doc_id", "done", "body", "n_bytes", "spans", "ranges", "refine", "spread"])

    return rows.mapInArrow(apply, _STATE)


def repeated_windows(spans: list[bytes], keys: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement over the suffixes of ``spans``: (span, place) of windows that a smaller (key, place) has too.

    Initial buckets are 8-grams; pointers of 8, 16, 32, ... bytes later split
    them until ``length`` bytes agree. Suffixes too short for a depth are put first.
    """
    data = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.array([len(s) for s in spans], np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(spans)), sizes)
    left = (begin + sizes)[owner] - np.arange(len(data))
    step = min(8, length)
    grams = np.zeros(len(data), np.uint64)
    for i in range(step):  # big-endian: buckets in the order of the bytes
        grams[: len(data) - i] += data[i:].astype(np.uint64) << np.uint64(8 * (step - 1 - i))
    grams[left < step] = 0
    order = np.argsort(grams)
    new = np.r_[True, grams[order][1:] != grams[order][:-1]]
    pointers = np.empty(len(data), np.int64)
    pointers[order] = np.maximum.accumulate(np.where(new, np.arange(len(data)), 0))
    depth = step
    while depth < length:
        step = min(depth, length - depth)
        target = np.minimum(np.arange(len(data)) + step, len(data) - 1)
        if not refine(pointers, np.where(left >= depth + step, pointers[target] + 1, 0)):
            break
        depth += step
    window = np.flatnonzero(left >= length)
    if not len(window):
        return window, window
    key, place = keys[owner[window]], firsts[owner[window]] + window - begin[owner[window]]
    order = np.lexsort((place, key, pointers[window]))
    pointer = pointers[window][order]
    repeat = np.r_[False, pointer[1:] == pointer[:-1]]
    chosen = np.sort(window[order[repeat]])
    return owner[chosen], chosen - begin[owner[chosen]]


def refine_buckets(spans: DataFrame, length: int, kept: bool = False, batch_bytes: int = 1 << 21) -> DataFrame:
    """Rows (q, d, first, bytes) to runs (d, first, last) of their windows: the repeated ones, or the ``kept`` ones.

    A bucket meets in one task, which reads it sorted and refines some buckets at a time.
    """

    def work(held) -> pa.RecordBatch:
        _, keys, firsts, texts = (list(x) for x in zip(*held))
        keys, firsts = np.array(keys, np.int64), np.array(firsts, np.int64)
        span, place = repeated_windows(texts, keys, firsts, length)
        if kept:
            n = np.array([len(t) - length + 1 for t in texts])
            owner, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            stays = np.ones(len(owner), bool)
            stays[start[span] + place] = False
            span, place = owner[stays], np.flatnonzero(stays) - start[owner[stays]]
        head = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (place[1:] != place[:-1] + 1)]) if len(span) else np.zeros(0, np.int64)
        tail = np.r_[head[1:], len(span)] - 1 if len(span) else head
        at = firsts[span[head]]
        return pa.RecordBatch.from_arrays([pa.array(keys[span[head]]), pa.array((at + place[head]).astype(np.int32)), pa.array((at + place[tail]).astype(np.int32))], ["d", "first", "last"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                if row[0] != last and size >= batch_bytes:
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held:
            yield work(held)

    return spans.select("q", "d", "first", "bytes").repartition("q").sortWithinPartitions("q").mapInArrow(stream, "d bigint, first int, last int")


def refined_parts(spans: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans (q, d, first, at, bytes) to their parts (q, c, d, first, bytes), q the refined bucket and c the class.

    Part k has the windows in which k whole grams lie before the anchor. Its
    bucket starts as the anchor's and is refined, offset by offset, by the gram
    buckets at multiples of ``gram`` bytes before and after the anchor that each
    of its windows holds; so a sub-bucket agrees in all but less than two grams.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, d, first, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            data, offsets = flat_bytes(batch.column(4))
            for x, y in row_groups(offsets, Rolling.LIMIT):
                chunk = data[offsets[x] : offsets[y]]
                rolling, whole = Rolling(chunk), chunk.tobytes()
                begin, end = offsets[x:y] - offsets[x], offsets[x + 1 : y + 1] - offsets[x]
                anchor = begin + at[x:y] - first[x:y]
                for k in range((length - gram) // gram + 1):
                    low, high = np.maximum(begin, anchor - gram * (k + 1) + 1), np.minimum(end - length, anchor - gram * k)
                    i = np.flatnonzero(low <= high)
                    low, high, place = low[i], high[i], anchor[i]
                    bucket = mix(q[x:y][i].view(np.uint64) + np.uint64(k + 1))
                    after = max((length - gram * (k + 2) + 1) // gram, 0)
                    for j in (*range(1, after + 1), *range(-k, 0)):
                        bucket = mix(bucket * _ODD ^ mix(rolling.ranges(place + j * gram, place + (j + 1) * gram)))
                    spread = ((place - low).astype(np.uint64) << np.uint64(32)) + (high - low).astype(np.uint64) + np.uint64(1)
                    context = mix(rolling.ranges(low, high + length) ^ mix(spread))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(bucket.view(np.int64)), pa.array(context.view(np.int64)), pa.array(d[x:y][i]), pa.array((first[x:y][i] + low - begin[i]).astype(np.int32)),
                        pa.array([whole[a:b] for a, b in zip(low.tolist(), (high + length).tolist())], pa.binary())], ["q", "c", "d", "first", "bytes"])

    return spans.select("q", "d", "first", "at", "bytes").mapInArrow(cut, "q bigint, c bigint, d bigint, first int, bytes binary")


def first_windows(parts: DataFrame, length: int) -> DataFrame:
    """Parts (d, first, bytes) to (d, first, last) of each window's first occurrence: buckets refined down to whole windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            data, offsets = flat_bytes(batch.column(2))
            for x, y in row_groups(offsets, Rolling.LIMIT):
                chunk = data[offsets[x] : offsets[y]]
                n = np.diff(offsets[x : y + 1]) - length + 1
                owner = np.repeat(np.arange(x, y), n)
                start = np.arange(len(owner)) + np.repeat(offsets[x:y] - offsets[x] - (np.cumsum(n) - n), n)
                w1 = Rolling(chunk).grams(length)[start]
                # Bytes from behind and other numbers for them: a hash of its own.
                w2 = Rolling(255 - chunk[::-1]).grams(length)[::-1][start]
                places = first[owner] + start - (offsets[owner] - offsets[x])
                yield pa.RecordBatch.from_arrays([pa.array(mix(w1).view(np.int64)), pa.array(mix(w2).view(np.int64)), pa.array(d[owner]), pa.array(places.astype(np.int32))], ["w1", "w2", "d", "p"])

    rows = parts.select("d", "first", "bytes").mapInArrow(windows, "w1 bigint, w2 bigint, d bigint, p int")
    least = rows.groupBy("w1", "w2").agg(F.min(F.struct("d", "p")).alias("m"))
    return least.select("m.d", F.col("m.p").alias("first"), F.col("m.p").alias("last"))


def kept_windows(spread: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans (q, d, first, at, bytes) of hot buckets to the runs (d, first, last) of windows that occur nowhere earlier."""
    classes = refined_parts(spread, length, gram).groupBy("q", "c").agg(F.min(F.struct("d", "first", "bytes")).alias("m"))
    parts = stage(classes.select("q", "m.d", "m.first", "m.bytes"), "parts")
    large = stage(parts.groupBy("q").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS).select("q"), "large")
    kept = refine_buckets(parts.join(large, "q", "left_anti"), length, kept=True)
    return kept if large.isEmpty() else kept.unionByName(first_windows(parts.join(large, "q", "left_semi"), length))


def finish(rows: DataFrame, length: int) -> DataFrame:
    """Pending documents with the results of refinement to settled ones."""

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, spans = [], []
            for text, ranges, spread, refined, kept in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5, 6, 7))):
                packed, stays = np.array(refined, np.int64), np.sort(np.array(kept, np.int64))
                places = np.concatenate([np.zeros(0, np.int64), *(np.arange(s["first"], s["first"] + len(s["bytes"]) - length + 1) for s in spread)])
                if len(stays):
                    run = np.searchsorted(stays >> 32, places, side="right") - 1
                    places = places[(run < 0) | (places > (stays & 0xFFFFFFFF)[run])]
                gone = [np.array(ranges, np.int64).reshape(-1, 2), np.stack([packed >> 32, packed & 0xFFFFFFFF], 1), np.stack([places, places], 1)]
                got = np.concatenate(gone)
                got = got[np.lexsort((got[:, 1], got[:, 0]))]
                _, start, stop = _merged(np.zeros(len(got), np.int64), got[:, 0], got[:, 1] + length)
                bodies.append(_cut(text, start, stop))
                spans.append(np.stack([start, stop], 1).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(spans, pa.list_(pa.int32())), pa.array(bodies, pa.binary())], ["_key", "doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(end, "_key bigint, doc_id bigint, n_bytes bigint, spans array<int>, kept binary")


def remove_repeats(keyed: DataFrame, key: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which also starts earlier.

    ``keyed`` has a unique long ``key`` that orders the documents, doc_id and
    text. Earlier means a smaller key, or the same document and an earlier start;
    strings are judged on the input. Returns _key, doc_id, n_bytes, spans (flat
    disjoint [start, end) pairs of removed bytes, touching ones joined) and kept
    (binary: a span may begin or end inside a character).

    Null or empty texts, and texts shorter than ``length``, keep all they have.
    Repeated rows are documents of their own: later ones lose all that is long
    enough. An empty table gives an empty result.
    """
    if not 8 <= gram <= length:
        raise ValueError("8 <= gram <= length is needed")
    spark = keyed.sparkSession
    ship_package(spark)
    docs = keyed.select(F.col(key).alias("_key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hot = hot_grams(docs, "_key", length, gram)
    # A bucket's anchors meet by gram; those of a hot gram are dealt by class.
    dealt = emit_anchors(docs, "_key", hot, length, gram).repartition(F.when(F.col("hot"), F.xxhash64("q", "c")).otherwise(F.col("q")))
    codes = dealt.sortWithinPartitions("q", "c", "d").mapInArrow(settle, "d bigint, code bigint")
    lists = codes.groupBy(F.col("d").alias("_key")).agg(F.collect_list("code").alias("codes"))
    coded = docs.join(lists, "_key", "left").select("_key", "doc_id", "text", F.coalesce("codes", F.array().cast("array<bigint>")).alias("codes"))
    path = scratch_path(spark, "repeats")
    apply_codes(coded, hot, length, gram).write.option("compression", "zstd").parquet(path)
    state = spark.read.schema(_STATE).parquet(path)
    pending = state.filter("NOT done")
    spans = lambda column: pending.select(F.col("_key").alias("d"), F.explode(column).alias("s")).select("d", "s.*")
    run = F.shiftleft(F.col("first").cast("bigint"), 32).bitwiseOR(F.col("last").cast("bigint"))
    none = F.lit(None).cast("bigint")
    refined = refine_buckets(spans("refine"), length).select("d", run.alias("gone"), none.alias("kept"))
    kept = kept_windows(spans("spread"), length, gram).select("d", none.alias("gone"), run.alias("kept"))
    found = refined.unionByName(kept).groupBy(F.col("d").alias("_key")).agg(F.collect_list("gone").alias("gone"), F.collect_list("kept").alias("kept"))
    empty = F.array().cast("array<bigint>")
    ended = pending.join(found, "_key", "left").select(
        "_key", "doc_id", "body", "n_bytes", "ranges", "spread", F.coalesce("gone", empty).alias("gone"), F.coalesce("kept", empty).alias("kept"))
    settled = state.filter("done").select("_key", "doc_id", "n_bytes", "spans", F.col("body").alias("kept"))
    return settled.unionByName(finish(ended, length))
