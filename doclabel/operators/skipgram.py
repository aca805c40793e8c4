"""Skip-gram word vectors trained by blocks of words; nothing on the driver grows with the vocabulary.

Words are numbered by falling frequency and dealt to P blocks in turn, so blocks
hold frequent and rare words alike. The corpus is read once, into counts of word
pairs within the window. They are packed once into arrays by the blocks of their two
words, so that a round moves some arrays and no single pairs. Training goes in
rounds: in round r the targets of block b meet the contexts of block b + r and the
pairs between the two. The P meetings of a round share no vector, so they run side
by side, each in one task of bounded size, and P rounds see every pair once.
Every meeting writes its blocks to the shared folder: a lost executor repeats one
round's task. All draws are seeded by epoch, round and block, and P follows from
the data, so the result does not depend on the number of cores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclabel.operators.dictionary import unfolded, with_ids
from doclabel.operators.lookup import measured_bytes
from doclabel.operators.ordering import with_dense_id
from doclabel.session import ship_package
from doclabel.staging import scratch_path, stage

# Bytes of pairs, and of vectors, that one task holds at a time.
TASK_BYTES = 64 << 20
PAIR_BYTES, SLICE, BATCH, SHARED = 24, 1 << 20, 1024, 64
# Batches of a meeting at most: a larger meeting has larger batches.
STEPS = 64
# Pairs of one row of packed arrays.
PIECE = 1 << 20
NOISE_POWER = 0.75  # fixed value of the published method
STATE = "b bigint, kind string, vectors binary, squares binary, counts binary"
PACKED = "shift int, at bigint, piece int, t binary, c binary, n binary"


def _summed(codes: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their weights added up."""
    code, weight = np.concatenate(codes), np.concatenate(weights)
    order = np.argsort(code)
    code, weight = code[order], weight[order]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[starts], np.add.reduceat(weight, starts)


def unordered_counts(ids: DataFrame, name: str, window: int) -> DataFrame:
    """``pair_counts`` of the pairs with t <= c only, which say all.

    Pairs are added up within a task, as far as ``TASK_BYTES`` hold them, before they are shuffled.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, weights, held = [], [], 0
        for _, flat, offsets in unfolded(batches, 0):
            words = flat.to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            for start in range(0, len(words), SLICE):
                for k in range(1, window + 1):
                    near = slice(start + k, min(start + SLICE, len(words) - k) + k)
                    here = slice(start, near.stop - k)
                    if here.stop <= here.start:
                        break
                    a, b = words[here], words[near]
                    both = (a >= 0) & (b >= 0) & (text[here] == text[near])
                    low, high = np.minimum(a[both], b[both]), np.maximum(a[both], b[both])
                    codes.append((low << 32) | high)
                    weights.append(np.full(len(low), window - k + 1))
                    held += len(low)
                if held * 16 >= TASK_BYTES:
                    yield _batch_of(*_summed(codes, weights))
                    codes, weights, held = [], [], 0
        if held:
            yield _batch_of(*_summed(codes, weights))

    rows = ids.select(name).mapInArrow(pairs, "t bigint, c bigint, n bigint")
    return rows.groupBy("t", "c").agg(F.sum("n").alias("n"))


def _batch_of(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code >> 32), pa.array(code & 0xFFFFFFFF), pa.array(n)], ["t", "c", "n"])


def pair_counts(ids: DataFrame, name: str, window: int) -> DataFrame:
    """``(t, c, n)``: how often word c is near word t, a neighbour at distance k of ``window`` w counting w - k + 1.

    ``name`` is a list of word numbers, below 0 for unknown words, which keep their places.
    """
    there, back = F.struct("t", "c", "n"), F.struct(F.col("c").alias("t"), F.col("t").alias("c"), (F.col("n")).alias("n"))
    once = unordered_counts(ids, name, window)
    return once.select(F.explode(F.when(F.col("t") == F.col("c"), F.array(F.struct("t", "c", (2 * F.col("n")).alias("n")))).otherwise(F.array(there, back))).alias("p")).select("p.*")


def packed_pairs(once: DataFrame, blocks: int) -> DataFrame:
    """The pairs of ``unordered_counts``, both ways round, as arrays by the blocks of their words.

    A row holds ``PIECE`` pairs at most of target block ``at`` with context block ``at`` +
    ``shift``: places within the blocks as 32-bit and counts as 64-bit integers, in the order of
    target, context and ``piece``. A pair is shuffled once for both its directions.
    """

    def pack(group: pa.Table) -> pa.Table:
        t, c, n = (group[k].to_numpy() for k in "tcn")
        low, high = (int(group[k][0].as_py()) for k in ("low", "high"))
        if low == high:
            other = t != c
            cells = [(low, low, np.append(t, c[other]), np.append(c, t[other]), np.append(np.where(other, n, 2 * n), n[other]))]
        else:
            turned = t % blocks != low
            x, y = np.where(turned, c, t), np.where(turned, t, c)
            cells = [(low, high, x, y, n), (high, low, y, x, n)]
        rows = []
        for at, to, x, y, n in cells:
            x, y = x // blocks, y // blocks
            order = np.argsort((x << 32) | y)
            for piece, start in enumerate(range(0, len(order), PIECE)):
                of = order[start : start + PIECE]
                rows.append(((to - at) % blocks, at, piece, x[of].astype(np.int32).tobytes(), y[of].astype(np.int32).tobytes(), n[of].astype(np.int64).tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["shift", "at", "piece", "t", "c", "n"])

    of = [F.pmod(k, F.lit(blocks)) for k in "tc"]
    return once.select(F.least(*of).alias("low"), F.greatest(*of).alias("high"), "t", "c", "n").groupBy("low", "high").applyInArrow(pack, PACKED)


def n_blocks(n_words: int, n_pairs: int, dim: int, task_bytes: int = TASK_BYTES) -> int:
    """The least number of blocks with which a meeting's pairs and vectors stay within ``task_bytes`` each, at least 4."""
    by_pairs = math.sqrt(n_pairs * PAIR_BYTES / task_bytes)
    return max(4, math.ceil(by_pairs), math.ceil(2 * n_words * dim * 4 / task_bytes))


def _row(block: int, kind: str, vectors: np.ndarray, squares: np.ndarray, counts: np.ndarray) -> dict:
    return {"b": block, "kind": kind, "vectors": vectors.astype(np.float32).tobytes(), "squares": squares.astype(np.float32).tobytes(), "counts": counts.astype(np.int64).tobytes()}


def _table(rows: list[dict]) -> pa.Table:
    fields = [("b", pa.int64()), ("kind", pa.string()), ("vectors", pa.binary()), ("squares", pa.binary()), ("counts", pa.binary())]
    return pa.Table.from_pylist(rows, pa.schema(fields))


def _first_blocks(ranked: DataFrame, blocks: int, dim: int, seed: int) -> DataFrame:
    """Two rows a block: small random target vectors and zero context vectors."""

    def make(group: pa.Table) -> pa.Table:
        order = np.argsort(group["id"].to_numpy())
        block, counts = int(group["b"][0].as_py()), group["n"].to_numpy()[order]
        drawn = np.random.default_rng((seed, block)).uniform(-0.5, 0.5, (len(counts), dim)) / dim
        nothing = np.zeros(len(counts))
        return _table([_row(block, "target", drawn, nothing, counts), _row(block, "context", np.zeros((len(counts), dim)), nothing, counts)])

    return ranked.select(F.pmod("id", F.lit(blocks)).alias("b"), "id", "n").groupBy("b").applyInArrow(make, STATE)


def _step(vectors: np.ndarray, squares: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """One AdaGrad step; a column belongs to a word."""
    squares += np.einsum("kj,kj->j", gradient, gradient) / len(gradient)
    gradient *= rate / np.sqrt(squares + np.float32(1e-8))
    vectors += gradient


def meet(targets, contexts, pairs, draw: np.random.Generator, negatives: int, rate: float) -> None:
    """Pass the pairs (target place, context place, weight) between two blocks (vectors, squares, counts) once, in place.

    Each batch of pairs shares its drawn negatives, which come from the context block by
    their damped frequency and together weigh ``negatives`` times each pair. A target meets
    them once a batch, with the weight of all its pairs.
    """
    (x, x2, _), (y, y2, seen), (t, c, w) = targets, contexts, pairs
    noise = np.cumsum(seen.astype(np.float64) ** NOISE_POWER)
    order = draw.permutation(len(t))
    size = max(BATCH, -(-len(t) // STEPS))
    xs, ys = np.array(x.T, np.float32, order="C"), np.array(y.T, np.float32, order="C")
    gx, gy = np.empty_like(xs), np.empty_like(ys)
    for start in range(0, len(order), size):
        of = np.sort(order[start : start + size])
        rows, columns, weight = t[of].astype(np.intp), c[of].astype(np.intp), w[of]
        other = np.searchsorted(noise, draw.random(SHARED) * noise[-1], side="right").clip(0, len(seen) - 1)
        a, b = xs.take(rows, 1), ys.take(columns, 1)
        push = weight * (1 - _sigmoid(np.einsum("kj,kj->j", a, b)))
        for k in range(len(xs)):
            gx[k] = np.bincount(rows, push * b[k], gx.shape[1])
            gy[k] = np.bincount(columns, push * a[k], gy.shape[1])
        mass = np.bincount(rows, weight, gx.shape[1])
        met = np.flatnonzero(mass)
        a, z = xs[:, met], ys[:, other]
        pull = _sigmoid(z.T @ a)
        pull *= (-(negatives / SHARED) * mass[met]).astype(np.float32)
        gx[:, met] += z @ pull
        np.add.at(gy.T, other, pull @ a.T)
        _step(xs, x2, gx, rate)
        _step(ys, y2, gy, rate)
    x[:], y[:] = xs.T, ys.T


def _sigmoid(v: np.ndarray) -> np.ndarray:
    v = np.clip(v, -30, 30)
    np.exp(np.negative(v, out=v), out=v)
    v += 1
    return np.reciprocal(v, out=v)


def _round(state: DataFrame, pairs: DataFrame, shift: int, blocks: int, dim: int, seeds: tuple[int, ...], negatives: int, rate: float, keep: float) -> DataFrame:
    """State after the targets of every block b met the contexts of block b + shift."""

    def train(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = {}
        for row in left.to_pylist():
            counts = np.frombuffer(row["counts"], np.int64)
            sides[row["kind"]] = (row["b"], (np.frombuffer(row["vectors"], np.float32).reshape(-1, dim).copy(), np.frombuffer(row["squares"], np.float32).copy(), counts))
        if len(sides) == 2 and len(right):
            (block, targets), (_, contexts) = sides["target"], sides["context"]
            pieces = sorted(right.to_pylist(), key=lambda row: row["piece"])
            t, c, n = (np.concatenate([np.frombuffer(row[k], kind) for row in pieces]) for k, kind in (("t", np.int32), ("c", np.int32), ("n", np.int64)))
            # Very frequent words say little: weighed down as the published subsampling would drop them.
            weight = n * np.minimum(1, np.sqrt(keep / targets[2][t])) * np.minimum(1, np.sqrt(keep / contexts[2][c]))
            meet(targets, contexts, (t, c, weight.astype(np.float32)), np.random.default_rng((*seeds, block)), negatives, rate)
        return _table([_row(b, kind, *parts) for kind, (b, parts) in sides.items()])

    at = F.when(F.col("kind") == "target", F.col("b")).otherwise(F.pmod(F.col("b") - shift, F.lit(blocks)))
    met = pairs.filter(F.col("shift") == shift).select("at", "piece", "t", "c", "n")
    return state.withColumn("at", at).groupBy("at").cogroup(met.groupBy("at")).applyInArrow(train, STATE)


def train_skipgram(
    df: DataFrame, vocab: DataFrame, dim: int, window: int, words: str = "Abstract", min_count: int = 5, epochs: int = 3, seed: int = 0,
    negatives: int = 5, rate: float = 0.05, keep: float = 1e-3, blocks: int | None = None,
) -> DataFrame:
    """Word vectors ``(word, vector)`` of the vocabulary words met ``min_count`` times or more.

    ``keep`` is the share of all words above which a word's pairs are weighed down.
    Negatives come from the contexts of the same meeting, so that over an epoch a
    target meets the noise of every block. Null and empty lists say nothing; without
    any frequent word the result is empty. ``blocks`` changes the result, within
    what training with other seeds changes.
    """
    ship_package(df.sparkSession)
    counts = df.select(F.explode(words).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    known = counts.join(vocab.select("key"), "key", "left_semi").filter(F.col("n") >= min_count)
    ranked = stage(with_dense_id(known, F.desc("n"), "key"), "ranked")
    n_words, total = ranked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_words:
        return ranked.select(F.col("key").alias("word"), F.array().cast("array<float>").alias("vector"))
    once = stage(unordered_counts(with_ids(df.select(words), ranked, words, "_ids"), "_ids", window), "pairs")
    n_pairs = once.agg(F.coalesce(F.sum(F.when(F.col("t") == F.col("c"), 1).otherwise(2)), F.lit(0))).first()[0]
    p = blocks or n_blocks(n_words, n_pairs, dim)
    path = scratch_path(df.sparkSession, "pairs")
    packed_pairs(once, p).write.partitionBy("shift").parquet(path)
    pairs = df.sparkSession.read.schema(PACKED).parquet(path)
    state = stage(_first_blocks(ranked, p, dim, seed), "vectors")
    for epoch in range(epochs):
        for shift in range(p):
            state = stage(_round(state, pairs, shift, p, dim, (seed, epoch, shift), negatives, rate, keep * total), "vectors")
    return _named(state, ranked, p, dim)


def _named(state: DataFrame, ranked: DataFrame, blocks: int, dim: int) -> DataFrame:
    """The target vectors with their words."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = np.frombuffer(row["vectors"], np.float32)
                n = len(values) // dim
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) * blocks + row["b"]), lists], ["id", "vector"])

    rows = state.filter("kind = 'target'").select("b", "vectors").mapInArrow(unpack, "id bigint, vector array<float>")
    return rows.join(ranked, "id").select(F.col("key").alias("word"), "vector")


def nearest_words(vectors: DataFrame, queries: DataFrame, max_bytes: int = TASK_BYTES) -> DataFrame:
    """``(query, word, similarity)``: the word other than itself with the greatest cosine, for each query ``(word, vector)``.

    The queries are the small side: their measured size may be ``max_bytes`` at most.
    Each task keeps its best word a query, so what is shuffled does not grow with a query's rivals.
    Words of equal cosine go by name; zero vectors are as far as can be.
    """
    if (size := measured_bytes(queries.select("word", "vector"))) > max_bytes:
        raise ValueError(f"the queries hold {size} bytes, more than {max_bytes}: ask in parts")
    asked = queries.select("word", "vector").orderBy("word").toArrow()
    names = asked["word"].to_pylist()
    wanted = _unit(np.array(asked["vector"].to_pylist(), np.float32).reshape(len(names), -1))
    place = {w: i for i, w in enumerate(names)}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(-2.0, "")] * len(names)
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words or not names:
                continue
            order = np.argsort(np.array(words, object), kind="stable")
            near = wanted @ _unit(np.array(batch.column(1).to_pylist(), np.float32)).T
            for j, w in enumerate(words):
                if w in place:
                    near[place[w], j] = -2.0
            found = order[near[:, order].argmax(1)]
            for i, j in enumerate(found):
                if (-near[i, j], words[j]) < (-top[i][0], top[i][1]) and near[i, j] > -2.0:
                    top[i] = (float(near[i, j]), words[j])
        kept = [(q, w, s) for q, (s, w) in zip(names, top) if s > -2.0]
        yield pa.RecordBatch.from_pylist([{"query": q, "word": w, "similarity": s} for q, w, s in kept], pa.schema([("query", pa.string()), ("word", pa.string()), ("similarity", pa.float64())]))

    rows = vectors.select("word", "vector").mapInArrow(best, "query string, word string, similarity double")
    least = F.min(F.struct((-F.col("similarity")).alias("s"), "word")).alias("m")
    return rows.groupBy("query").agg(least).select("query", F.col("m.word").alias("word"), (-F.col("m.s")).alias("similarity"))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
