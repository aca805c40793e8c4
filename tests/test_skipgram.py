from collections import Counter

import numpy as np
import pytest

from doclabel.operators import skipgram

SCHEMA = "paper_id bigint, Abstract array<string>"


def topical(n=120):
    """Texts of two topics whose words never meet."""
    draw = np.random.default_rng(3)
    return [(i, [f"{'ab'[i % 2]}{draw.integers(12)}" for _ in range(40)]) for i in range(n)]


def vocab_of(spark, rows):
    return spark.createDataFrame([(w,) for w in sorted({w for _, words in rows for w in words or []})], "key string")


def test_pair_counts_against_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(1)
    lists = [[int(x) for x in draw.integers(-1, 6, size)] for size in (0, 1, 2, 30, 57)]
    want = Counter()
    for ids in lists:
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if i != j and abs(i - j) <= 3 and a >= 0 and b >= 0:
                    want[a, b] += 3 - abs(i - j) + 1
    df = spark.createDataFrame([(x,) for x in [*lists, None]], "ids array<bigint>").coalesce(1)
    for size in (1 << 20, 7):
        monkeypatch.setattr(skipgram, "SLICE", size)
        got = {(r["t"], r["c"]): r["n"] for r in skipgram.pair_counts(df, "ids", 3).collect()}
        assert got == want


def test_meeting_against_plain_steps():
    """One batch equals the same gradients added up pair by pair."""
    draw = np.random.default_rng(5)
    x, y = draw.normal(size=(4, 3)).astype(np.float32), draw.normal(size=(5, 3)).astype(np.float32)
    seen = np.array([9, 7, 5, 3, 1])
    t, c, w = np.array([0, 1, 1, 3]), np.array([2, 2, 4, 0]), np.array([1, 2, 1, 3], np.float32)
    got = [(x.copy(), np.zeros(4, np.float32), seen), (y.copy(), np.zeros(5, np.float32), seen)]
    skipgram.meet(*got, (t, c, w), np.random.default_rng(8), 2, 0.1)
    again = np.random.default_rng(8)
    again.permutation(4)
    noise = np.cumsum(seen**0.75)
    other = np.searchsorted(noise, again.random(skipgram.SHARED) * noise[-1], side="right")
    gx, gy = np.zeros((4, 3)), np.zeros((5, 3))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for a, b, n in zip(t, c, w):
        push = n * (1 - sigmoid(x[a] @ y[b]))
        gx[a] += push * y[b]
        gy[b] += push * x[a]
        for z in other:
            pull = -n * 2 / skipgram.SHARED * sigmoid(x[a] @ y[z])
            gx[a] += pull * y[z]
            gy[z] += pull * x[a]
    for vectors, start, gradient in ((got[0], x, gx), (got[1], y, gy)):
        squares = (gradient**2).mean(1)
        assert vectors[1] == pytest.approx(squares, rel=1e-4)
        assert vectors[0] == pytest.approx(start + 0.1 * gradient / np.sqrt(squares + 1e-8)[:, None], abs=1e-4)


def test_vectors_tell_topics_apart(spark):
    rows = topical()
    df, vocab = spark.createDataFrame(rows, SCHEMA), vocab_of(spark, rows)
    trained = skipgram.train_skipgram(df, vocab, 8, 4, epochs=10)
    near = {r["query"]: r["word"] for r in skipgram.nearest_words(trained, trained).collect()}
    assert len(near) == 24 and all(q[0] == w[0] and q != w for q, w in near.items())


def test_result_does_not_depend_on_partitions(spark):
    rows = topical(30)
    vocab = vocab_of(spark, rows)
    train = lambda n: {r["word"]: r["vector"] for r in skipgram.train_skipgram(spark.createDataFrame(rows, SCHEMA).repartition(n), vocab, 4, 3, epochs=2).collect()}
    assert train(1) == train(5)


def test_block_count_bounds_a_task():
    assert skipgram.n_blocks(1000, 1000, 16) == 4
    for words, pairs, dim in ((10**7, 10**9, 100), (10**5, 10**10, 100), (10**8, 10**6, 300)):
        p = skipgram.n_blocks(words, pairs, dim)
        assert pairs / p**2 * skipgram.PAIR_BYTES <= skipgram.TASK_BYTES and 2 * words / p * dim * 4 <= skipgram.TASK_BYTES


def test_awkward_lists(spark):
    rows = [(1, None), (2, []), (3, ["a"] * 6), (4, ["a", None, "zz"]), (5, ["b"])]
    df, vocab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a",), ("b",)], "key string")
    got = skipgram.train_skipgram(df, vocab, 3, 2).collect()
    assert [r["word"] for r in got] == ["a"] and all(np.isfinite(got[0]["vector"]))
    assert skipgram.train_skipgram(df.filter("paper_id < 3"), vocab, 3, 2).collect() == []


def test_nearest_words_against_brute_force(spark):
    draw = np.random.default_rng(2)
    table = {f"w{i:02d}": draw.normal(size=4).astype(np.float32) for i in range(40)}
    table["w99"] = table["w00"]  # a tie goes by name
    df = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in table.items()], "word string, vector array<float>").repartition(5)
    got = {r["query"]: r["word"] for r in skipgram.nearest_words(df, df.filter("word < 'w20'")).collect()}
    unit = {w: v / np.linalg.norm(v) for w, v in table.items()}
    for q, w in got.items():
        best = max(float(unit[q] @ unit[o]) for o in table if o != q)
        assert float(unit[q] @ unit[w]) == pytest.approx(best, abs=1e-6)
    assert len(got) == 20 and got["w00"] == "w99"
    with pytest.raises(ValueError, match="ask in parts"):
        skipgram.nearest_words(df, df, max_bytes=10)


def test_packed_pairs_are_the_pairs_both_ways(spark, monkeypatch):
    draw = np.random.default_rng(4)
    df = spark.createDataFrame([([int(x) for x in draw.integers(-1, 9, 50)],) for _ in range(6)], "ids array<bigint>")
    want = {(r["t"], r["c"]): r["n"] for r in skipgram.pair_counts(df, "ids", 3).collect()}
    monkeypatch.setattr(skipgram, "PIECE", 5)
    for blocks in (1, 4):
        got, order = {}, {}
        for r in sorted(skipgram.packed_pairs(skipgram.unordered_counts(df, "ids", 3), blocks).collect(), key=lambda r: (r["at"], r["shift"], r["piece"])):
            t, c = (np.frombuffer(r[k], np.int32) for k in "tc")
            assert 0 < len(t) <= 5
            other = (r["at"] + r["shift"]) % blocks
            got |= {(int(a) * blocks + r["at"], int(b) * blocks + other): int(n) for a, b, n in zip(t, c, np.frombuffer(r["n"], np.int64))}
            order.setdefault((r["at"], other), []).extend(zip(t.tolist(), c.tolist()))
        assert got == want and sum(map(len, order.values())) == len(want) and all(v == sorted(v) for v in order.values())


def test_a_large_meeting_has_larger_batches_not_more():
    class Draw:
        calls, source = 0, np.random.default_rng(0)

        def permutation(self, n):
            return self.source.permutation(n)

        def random(self, n):
            self.calls += 1
            return self.source.random(n)

    t, c = (x.ravel() for x in np.meshgrid(np.arange(400), np.arange(400)))
    sides = [(np.full((400, 2), 0.1, np.float32), np.zeros(400, np.float32), np.ones(400, np.int64)) for _ in range(2)]
    draw = Draw()
    skipgram.meet(*sides, (t, c, np.ones(len(t), np.float32)), draw, 5, 0.05)
    assert draw.calls == skipgram.STEPS == 64 and all(np.isfinite(s[0]).all() and (s[1] > 0).all() for s in sides)


def test_no_pairs_leave_the_first_vectors(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["b"])], SCHEMA)
    got = skipgram.train_skipgram(df, spark.createDataFrame([("a",), ("b",)], "key string"), 3, 2, min_count=1, epochs=1).collect()
    assert sorted(r["word"] for r in got) == ["a", "b"]
