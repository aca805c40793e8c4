import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclabel.operators import labels, scores, splits, vectors
from doclabel.plans import features, training
from doclabel.plans.stages import CodeCleaner
from doclabel.sources.tables import at_depth

WORDS = ["w0", "w1", "w2", "w3", "w4"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    docs = [(rng.randrange(3) * 2, [rng.choice(WORDS[:4] + ["zz"]) for _ in range(rng.randrange(1, 9))]) for _ in range(25)]
    vocab = spark.createDataFrame([(w, i, "NNP" if i == 1 else "NN", 1) for i, w in enumerate(WORDS)], "key string, id bigint, tag string, freq bigint")
    return docs, vocab, spark.createDataFrame(docs, "label int, Abstract array<string>")


def dense_counts(docs, n_labels):
    counts = np.zeros((len(WORDS), n_labels))
    for label, words in docs:
        for w in words:
            if w in WORDS:
                counts[WORDS.index(w), label] += 1
    return counts


def test_tfidf_equals_dense_formula(data):
    docs, vocab, df = data
    counts = dense_counts(docs, 5)
    with np.errstate(all="ignore"):
        tf = np.nan_to_num(0.5 + 0.5 * counts / counts.max(axis=0))
        df_count = (tf > 0.5).sum(axis=1)
        idf = np.log(1 + np.where(df_count > 0, len({d[0] for d in docs}) / df_count, 0))
    want = (tf.sum(axis=1) - tf.sum(axis=1).min()) * idf
    got = scores.tfidf(vocab, df).orderBy("id").collect()
    assert [r["tfidf"] for r in got] == pytest.approx(list(want), abs=1e-12)
    assert [r["idf"] for r in got] == pytest.approx(list(idf), abs=1e-12)


@pytest.mark.parametrize("normalized", [False, True])
def test_information_gain_equals_dense_formula(data, normalized):
    docs, vocab, df = data
    used = sorted({d[0] for d in docs})
    counts = dense_counts(docs, 5)[:, used]
    p_label = (np.array([sum(d[0] == u for d in docs) for u in used]) + 1) / (len(docs) + len(used))
    p_w = (counts + 1).sum(axis=1) / (counts.sum() + counts.size)
    x = (counts + 1) / (counts.sum(axis=0) + len(WORDS)) * p_label / p_w[:, None]
    if normalized:
        x = x / x.sum(axis=1, keepdims=True)
    want = -(p_label * np.log2(p_label)).sum() + (x * np.log2(x)).sum(axis=1)
    cells = scores.label_word_counts(df, vocab)
    got = scores.information_gain(df, cells, vocab, normalized=normalized).orderBy("id").collect()
    assert [r["gain"] for r in got] == pytest.approx(list(want), abs=1e-9)
    posterior = scores.label_given_word(scores.word_label_probs(df, cells, vocab), normalized)
    assert posterior.count() == x.size
    total = posterior.agg(F.sum("p_label_word")).first()[0]
    assert total == pytest.approx(x.sum(), abs=1e-9)
    if normalized:
        sums = posterior.groupBy("id").agg(F.sum("p_label_word").alias("s")).collect()
        assert [r["s"] for r in sums] == pytest.approx([1.0] * len(WORDS))


def test_information_gain_of_texts_skips_the_last_word(spark, data):
    _, vocab, _ = data
    texts = spark.createDataFrame([(0, "w0 w1 w2"), (1, "w2 w0")], "label int, Abstract string")
    cut = spark.createDataFrame([(0, ["w0", "w1"]), (1, ["w2"])], "label int, Abstract array<string>")
    by_text = features.information_gain(texts, vocab).orderBy("id").collect()
    by_list = scores.information_gain(cut, scores.label_word_counts(cut, vocab), vocab).orderBy("id").collect()
    assert [r["gain"] for r in by_text] == pytest.approx([r["gain"] for r in by_list])


def test_top_and_bottom(spark):
    rows = [(f"k{i}", i, tag, 0.0, v) for i, (tag, v) in enumerate([("NN", 3.0), ("NNP", 1.0), ("NN", 3.0), ("NN", 2.0), ("NNP", 5.0)])]
    c = spark.createDataFrame(rows, "key string, id bigint, tag string, idf double, tfidf double")

    def keys(df):
        return [r["key"] for r in df.orderBy("place").collect()]

    assert keys(scores.top_n(c, 3)) == ["k4", "k0", "k2"]
    assert keys(scores.bottom_n(c, 3)) == ["k2", "k3", "k1"]
    assert keys(scores.bottom_n(c, 0)) == [] == keys(scores.top_n(c, 0))
    assert keys(scores.bottom_n_proper_nouns(c, 9)) == ["k4", "k1"]
    assert keys(scores.bottom_n_others(c, 2)) == ["k2", "k3"]


@pytest.fixture(scope="module")
def bank(spark):
    return spark.createDataFrame([("14", 0, "A"), ("05", 1, "B")], "key string, id int, description string")


def test_label_expansion(spark):
    bank = spark.createDataFrame([(k, i, "") for i, k in enumerate("abc")], "key string, id int, description string")
    papers = spark.createDataFrame([("input_1", ["a", "b"]), ("input_2", ["c"])], "Abstract string, MSCs array<string>")
    got = [tuple(r) for r in labels.explode_labels(papers, bank).collect()]
    assert sorted(got) == [("input_1", "a"), ("input_1", "b"), ("input_2", "c")]


def test_large_banks_are_joined(spark, bank, monkeypatch):
    papers = spark.createDataFrame([(1, "14|05|99|14"), (2, ""), (3, "05"), (4, None)], "paper_id bigint, MSCs string")
    by_literal = sorted(labels.clean_codes(papers, bank, 2).collect())
    monkeypatch.setattr(labels, "LITERAL_BANK", 0)
    assert sorted(labels.clean_codes(papers, bank, 2).collect()) == by_literal
    with pytest.raises(ValueError, match="common length"):
        labels.code_length(bank.union(spark.createDataFrame([("141", 3, "")], bank.schema)))


def test_codes(spark, bank):
    papers = spark.createDataFrame([(1, "14B13|05C15|14A10|99X99"), (2, ""), (3, "05A05")], "paper_id bigint, MSCs string")
    cleaned = {r["paper_id"]: r["MSCs"] for r in CodeCleaner(bank, 2).transform(papers).collect()}
    assert cleaned == {1: ["14", "05"], 2: [], 3: ["05"]}
    assert at_depth(papers, 5).first()["MSCs"] == "14B13|05C15|14A10|99X99"
    single = spark.createDataFrame([("14B13",)], "MSCs string")
    assert at_depth(single, 3).first()["MSCs"] == "14B"
    with pytest.raises(ValueError):
        at_depth(papers, 4)
    primary = labels.label_index(labels.primary_label(labels.clean_codes(papers, bank, 2), bank), bank)
    assert {r["paper_id"]: r["y"] for r in primary.collect()} == {1: 0, 3: 1}
    vector = labels.multi_label_vector(labels.clean_codes(papers, bank, 2), bank)
    assert {r["paper_id"]: r["y"] for r in vector.collect()} == {1: [1, 1], 2: [0, 0], 3: [0, 1]}
    chosen, small = labels.select_labels(labels.clean_codes(papers, bank, 2), bank, ["05", "77"])
    assert [r["paper_id"] for r in chosen.collect()] == [3]
    assert [(r["key"], r["id"]) for r in small.collect()] == [("05", 0)]


@pytest.mark.parametrize("n", [1, 5, 9, 10, 11, 37])
def test_splits_cover_and_match_positions(spark, n):
    ids = [i * 7 - 20 for i in range(n)]
    df = spark.createDataFrame([(i,) for i in ids], "paper_id int").repartition(3)

    def parts(split):
        return [r["split"] for r in split.orderBy("paper_id").collect()]

    cut = int(n * 0.8)
    assert parts(splits.split_80_20(df)) == ["train"] * cut + ["test"] * (n - cut)
    a, b = n * 80 // 100, n * 90 // 100
    assert parts(splits.split_80_10_10(df)) == ["train"] * a + ["test"] * (b - a) + ["validation"] * (n - b)
    tail = min(n * 10 // 100, 2)
    assert parts(splits.split_tail(df, [F.col("paper_id")], limit=2)) == ["train"] * (n - tail) + ["test"] * tail
    sliced = splits.slice_train(splits.split_80_20(df), 1, 3)
    assert sorted(r["paper_id"] for r in sliced.collect()) == ids[:cut][1:3] + ids[cut:]
    batches = sorted((r["paper_id"], r["batch"]) for r in splits.mini_batches(df, 4).collect())
    assert batches == [(v, k // 4) for k, v in enumerate(ids) if k // 4 < n // 4]


def test_shuffle_is_a_permutation_independent_of_partitions(spark):
    df = spark.range(200).withColumnRenamed("id", "paper_id")
    one = {r["paper_id"]: r["position"] for r in splits.shuffle_seeded(df.repartition(1)).collect()}
    many = {r["paper_id"]: r["position"] for r in splits.shuffle_seeded(df.repartition(7)).collect()}
    assert one == many and sorted(one.values()) == list(range(200)) and [one[i] for i in range(200)] != list(range(200))


def test_padded_sequence(spark):
    known = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vector array<float>")
    papers = spark.createDataFrame([(1, ["a", "x", "b", "a"]), (2, ["x"]), (3, [])], "paper_id bigint, Abstract array<string>")
    got = {r["paper_id"]: (r["x"], r["effective_length"]) for r in splits.padded_sequence(papers, known, 2, 3).collect()}
    zero = [0.0, 0.0]
    assert got == {1: ([[1.0, 2.0], [3.0, 4.0], zero], 2), 2: ([zero] * 3, 0), 3: ([zero] * 3, 0)}


def test_training_sets(spark, bank):
    papers = spark.createDataFrame([(i, ["a", "b", "a"], ["14"] if i % 2 else ["05", "14"]) for i in range(10)], "paper_id bigint, Abstract array<string>, MSCs array<string>")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "key string, id bigint")
    split = training.unigram_training_set(papers)
    counts, truth = training.unigram_test_matrices(split, vocab, bank)
    assert {(r["paper_id"], r["id"]): r["n"] for r in counts.collect()} == {(8, 0): 2, (8, 1): 1, (9, 0): 2, (9, 1): 1}
    assert {r["paper_id"]: r["y"] for r in truth.collect()} == {8: [0.5, 0.5], 9: [1.0, 0.0]}
    doubled, _ = training.unigram_test_matrices(split, vocab, bank, per_code_counts=True)
    assert {(r["paper_id"], r["id"]): r["n"] for r in doubled.collect()} == {(8, 0): 4, (8, 1): 2, (9, 0): 2, (9, 1): 1}
    known = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<float>")
    samples = training.rnn_training_set(papers, known, bank, 2, 4).collect()
    assert len(samples) == 10 and sum(r["split"] == "test" for r in samples) == 1
    assert all(r["length"] == 3 and r["effective_length"] == 2 and len(r["x"]) == 4 for r in samples)
    some = training.rnn_training_set(papers, known, bank, 2, 4, selection=["14"]).collect()
    assert sorted(r["paper_id"] for r in some) == [1, 3, 5, 7, 9] and {r["y"] for r in some} == {0}


def test_document_vectors(spark):
    known = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<float>")
    papers = spark.createDataFrame([(1, "a a q"), (2, "q q")], "paper_id bigint, Abstract string")
    got = {r["paper_id"]: r["vector"] for r in vectors.doc_vector_concat(papers, known, 2, 3).collect()}
    assert got == {1: [1.0, 2.0] * 3, 2: [0.0] * 6}


def test_svd_vectors_are_orthonormal_and_span_the_counts(spark):
    rng = random.Random(0)
    names = [f"v{i}" for i in range(6)]
    lists = [[rng.choice(names) for _ in range(9)] for _ in range(40)]
    papers = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "paper_id bigint, Abstract array<string>")
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(names)], "key string, id bigint")
    got = {r["word"]: r["vector"] for r in vectors.train_svd_vectors(papers, vocab, 2).collect()}
    basis = np.array([got[w] for w in names])
    counts = np.array([[words[:-1].count(w) for words in lists] for w in names], dtype=float)
    u = np.linalg.svd(counts)[0][:, :2]
    assert basis.T @ basis == pytest.approx(np.eye(2), abs=1e-5)
    assert np.abs(np.sum(u * basis, axis=0)) == pytest.approx([1, 1], abs=1e-4)
    assert all(column[np.abs(column).argmax()] > 0 for column in basis.T)


def test_word2vec_keeps_vocabulary_words(spark):
    papers = spark.createDataFrame([(i, ["a", "b", "c"] * 5) for i in range(10)], "paper_id bigint, Abstract array<string>")
    vocab = spark.createDataFrame([("a",), ("c",)], "key string")
    trained = vectors.train_word2vec(papers, vocab, dim=7, partitions=1).collect()
    assert {r["word"] for r in trained} == {"a", "c"} and all(len(r["vector"]) == 7 for r in trained)
    # Beyond the driver's bound the vectors are trained by blocks of words.
    blocked = vectors.train_word2vec(papers, vocab, dim=7, max_bytes=100).collect()
    assert {r["word"] for r in blocked} == {"a", "c"} and all(len(r["vector"]) == 7 for r in blocked)
