"""Lookups in the row, sparse products, and the k-th row, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doclabel.operators import dictionary, lookup, models, ordering, scores, selection, splits, tokens
from suite import fixtures as fx

LISTS = [(1, ["a", "b", "c", "a"]), (2, []), (3, None), (4, ["zz"]), (5, ["b"]), (5, ["b"]), (6, ["a", None, "b", "é", "a_b"]), (7, ["a", "b"] * 3000)]
KEYS = [("a", 7), ("b", 0), ("a_b", 3), ("c_a", 9), ("é", 5), ("b_a", 1)]


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(LISTS, "paper_id bigint, Abstract array<string>").withColumn("_flags", F.lit("kept")).repartition(3)


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(KEYS, "key string, id bigint")


def plain_rewrite(words, keep_last):
    keys, out, words = {k for k, _ in KEYS}, [], words or []
    for i, w in enumerate(words):
        last = i == len(words) - 1
        if w in keys and (keep_last or not last):
            out.append(w)
        if not last and w is not None and words[i + 1] is not None and f"{w}_{words[i + 1]}" in keys:
            out.append(f"{w}_{words[i + 1]}")
    return out


@pytest.mark.parametrize("bound", [1 << 20, 60, 1])
@pytest.mark.parametrize("keep_last", [False, True])
def test_rewriting_whole_and_block_by_block(lists, vocab, monkeypatch, bound, keep_last):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", bound)
    got = tokens.select_in_vocab(lists, vocab, keep_last=keep_last)
    assert got.columns == lists.columns
    want = sorted((i, plain_rewrite(w, keep_last), "kept") for i, w in LISTS)
    assert sorted((r["paper_id"], r["Abstract"], r["_flags"]) for r in got.collect()) == want


@pytest.mark.parametrize("bound", [1 << 20, 40])
def test_ids_and_counts_in_the_row(lists, vocab, monkeypatch, bound):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", bound)
    ids = dict(KEYS)
    got = dictionary.with_ids(lists, vocab, "Abstract", "found").collect()
    assert sorted((r["paper_id"], r["found"]) for r in got) == sorted((i, [ids.get(w, -1) for w in words or []]) for i, words in LISTS)
    distinct = lists.filter("paper_id <> 5")
    cells = {(r["paper_id"], r["id"]): r["n"] for r in dictionary.counted(distinct, vocab, "paper_id", "Abstract").collect()}
    assert cells == {(i, k): n for i, words in LISTS if i != 5 for k, n in Counter(ids[w] for w in words or [] if w in ids).items()}


def test_empty_tables(spark, lists, vocab):
    assert tokens.select_in_vocab(lists.filter("paper_id = 99"), vocab).count() == 0
    none = tokens.select_in_vocab(lists, vocab.filter("id = 99")).collect()
    assert len(none) == len(LISTS) and all(r["Abstract"] == [] for r in none)


def test_no_document_is_shuffled(spark, sf_dir):
    """Neither rewriting nor scoring has an exchange."""
    corpus = fx.corpus(spark, sf_dir)
    rewritten = tokens.select_in_vocab(fx.words(spark, sf_dir), corpus.vocab)
    scorer = models.prepare_scorer(models.train_unigram(corpus.papers, corpus.vocab, fx.bank(spark)), corpus.vocab)
    for df in (rewritten, models.score_classes(corpus.papers, scorer)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan


@pytest.mark.parametrize("bound", [1 << 20, 100])
def test_sparse_product_against_plain_sums(spark, lists, monkeypatch, bound):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", bound)
    rows = {"a": {0: 1.5, 2: 2.0}, "b": {1: 0.25}, "é": {}, "zz": {2: 4.0}}
    keyed = spark.createDataFrame([(k, list(v), list(v.values())) for k, v in rows.items()], "key string, labels array<int>, gains array<double>")
    got = sorted((r["paper_id"], r["sums"]) for r in dictionary.added_gains(lists, keyed, "paper_id", "Abstract", 3).collect())
    want = sorted((i, [float(sum(w in rows for w in words or []))] + [sum(rows.get(w, {}).get(c, 0.0) for w in words or []) for c in range(3)]) for i, words in LISTS)
    assert got == want


# --- the k-th row -----------------------------------------------------------------------


def orders(seed):
    """Rows (a, b) of different shapes: ties, huge ranges, one value, heavy tails."""
    rnd = random.Random(seed)
    n = rnd.choice([1, 2, 700, 3000])
    draw = [
        lambda: rnd.randint(0, 3), lambda: rnd.choice([-(1 << 63), (1 << 63) - 1, 0, 5]), lambda: 7, lambda: int(rnd.paretovariate(0.3)) % (1 << 62),
        lambda: rnd.randint(-5, 5) + (1 << 60),
    ][seed % 5]
    values = [(draw(), i) for i in range(n)]
    rnd.shuffle(values)
    return values


@pytest.mark.parametrize("seed", range(10))
def test_keys_at_against_sorting(spark, monkeypatch, seed):
    monkeypatch.setattr(selection, "FEW", [2048, 3][seed % 2])
    monkeypatch.setattr(selection, "PARTS", [1024, 4][seed % 2])
    rows = orders(seed)
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(3)
    n, places = len(rows), [0, len(rows) // 3, len(rows) - 1, len(rows), -1]
    total, got = selection.keys_at(df, [F.col("a"), F.col("b")], lambda _: places)
    assert total == n and got == [sorted(rows)[p] if 0 <= p < n else None for p in places]


def test_keys_with_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1,), (None,)], "a bigint")
    assert selection.keys_at(df, [F.col("a")], lambda n: [0]) == (2, None)
    assert selection.keys_at(df.filter("a = 9"), [F.col("a")], lambda n: [0]) == (0, [None])
    assert ordering.boundaries(df, [F.col("a")], lambda n: [1])[0] == 2  # null ids are sorted instead
    assert selection.first_rows(df, [F.col("a")], 0).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_top_and_bottom_against_sorting(spark, monkeypatch, seed):
    monkeypatch.setattr(selection, "FEW", 5)
    monkeypatch.setattr(selection, "PARTS", 8)
    rnd = random.Random(seed)
    values = [[0.0, 1.0, 1.0 + 1e-12, None, float("nan"), float("inf"), -3.5], [1e308, -1e308, 0.1, 5e-324], [2.0], [rnd.random() for _ in range(50)]][seed]
    rows = [(i, rnd.choice(values)) for i in range(400)]
    container = spark.createDataFrame(rows, "id bigint, tfidf double").withColumn("key", F.col("id").cast("string")).repartition(4)
    by = F.round("tfidf", scores.TIE_DECIMALS)
    for n in (0, 1, 37, 400, 500):
        top = [r["id"] for r in scores.top_n(container, n).orderBy("place").collect()]
        assert top == [r["id"] for r in container.orderBy(F.desc(by), "id").limit(n).collect()]
        bottom = [r["id"] for r in scores.bottom_n(container, n).orderBy("place").collect()]
        assert bottom == [r["id"] for r in container.orderBy(F.asc(by), F.desc("id")).limit(n).collect()][::-1]


def test_splits_of_many_rows_do_not_sort(spark):
    df = spark.range(20_000).withColumn("paper_id", F.col("id") * 3 - 7000).drop("id").repartition(5)
    split = splits.split_80_10_10(df)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 16_000, "test": 2000, "validation": 2000}
    assert "Sort" not in split._jdf.queryExecution().executedPlan().toString()


def test_dense_ids_leave_columns_of_any_name_alone(spark):
    df = spark.createDataFrame([(3, "x", 9), (1, "y", 8)], "k int, _part string, _place int")
    got = ordering.with_dense_id(df, "k").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "y", 8, 0), (3, "x", 9, 1)]
