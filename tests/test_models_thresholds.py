import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from doclabel.functions import arrays
from doclabel.operators import metrics, models, thresholds
from suite.queries import QUERIES

WORDS = ["a", "b", "c", "d"]
PAPERS = [(1, ["a", "a", "b"], ["X"]), (2, ["b", "c", "zz"], ["X", "Y"]), (3, ["c", "c", "d"], ["Y", "unknown"])]


@pytest.fixture(scope="module")
def unigram(spark):
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(WORDS)], "key string, id bigint")
    bank = spark.createDataFrame([("X", 0, ""), ("Y", 1, ""), ("Z", 2, "")], "key string, id int, description string")
    papers = spark.createDataFrame(PAPERS, "paper_id bigint, Abstract array<string>, MSCs array<string>")
    return papers, vocab, bank, models.train_unigram(papers, vocab, bank)


def dense_topics():
    counts = np.zeros((3, 4))
    for _, words, codes in PAPERS:
        for code in codes:
            for w in words:
                if code in "XYZ" and w in WORDS:
                    counts["XYZ".index(code), WORDS.index(w)] += 1
    return (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)


def test_topics_equal_dense_form_and_naive_bayes(spark, unigram):
    _, _, _, model = unigram
    dense = dense_topics()
    for r in model.topics().collect():
        assert r["p"] == pytest.approx(dense[r["label_id"], r["word_id"]])
        if r["label_id"] == 0:
            assert r["p_unseen"] == pytest.approx(dense[0, 3])
    repeated = [("XYZ".index(c), Vectors.dense([words.count(w) for w in WORDS])) for _, words, codes in PAPERS for c in codes if c in "XYZ"]
    fitted = NaiveBayes(smoothing=1.0).fit(spark.createDataFrame([(float(y), x) for y, x in repeated], ["label", "features"]))
    assert np.exp(fitted.theta.toArray()) == pytest.approx(dense[:2])


@pytest.mark.parametrize("mode", ["linear", "log"])
def test_class_scores(spark, unigram, mode):
    _, vocab, _, model = unigram
    docs = [(1, ["a", "c", "a"]), (2, ["d", "zz"]), (3, ["zz"]), (4, [])]
    df = spark.createDataFrame(docs, "paper_id bigint, Abstract array<string>")
    got = {r["paper_id"]: r["p"] for r in models.class_scores(df, model, vocab, mode).collect()}
    dense = dense_topics()
    for number, words in docs:
        x = np.array([words.count(w) for w in WORDS])
        if mode == "linear":
            raw = dense @ x
            if raw.sum() == 0:
                assert got[number] is None
                continue
        else:
            raw = np.exp(np.log(dense) @ x)
        assert got[number] == pytest.approx(list(raw / raw.sum()))


def test_thousands_of_classes(spark):
    """Scores of 6,000 classes from sparse gains, against plain arithmetic."""
    k = 6000
    bank = spark.createDataFrame([(f"c{i}", i, "") for i in range(k)], "key string, id int, description string")
    papers = spark.createDataFrame([(["a", "b"], ["c5"]), (["b", "b", "c"], ["c5999"]), (["c"], ["c0"])], "Abstract array<string>, MSCs array<string>")
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate("abc")], "key string, id bigint")
    scorer = models.prepare_scorer(models.train_unigram(papers, vocab, bank), vocab)
    row = models.score_classes(spark.createDataFrame([(1, ["b", "c", "c"])], "paper_id bigint, Abstract array<string>"), scorer).first()
    n = np.zeros((k, 3))
    n[5], n[5999], n[0] = [1, 1, 0], [0, 2, 1], [0, 0, 1]
    raw = ((n + 1) / (n.sum(1, keepdims=True) + 3)) @ [0, 1, 2]
    assert row["p"] == pytest.approx(list(raw / raw.sum()))


def test_mlp_beats_majority(spark):
    rng = np.random.default_rng(0)
    rows = [([float(x) for x in rng.normal(3 * (i % 2), 0.5, 3)], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "vector array<double>, y int")
    scored = models.predict_mlp(df, models.train_mlp(df, [4], 3, 2, max_iter=50))
    assert metrics.top_k_accuracy(scored, 1, "p", "y").first()[0] > 0.9
    assert all(sum(r["p"]) == pytest.approx(1) for r in scored.collect())


def test_prefix_predictions(spark):
    known = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 5.0])], "word string, vector array<float>")
    bank = spark.createDataFrame([("X", 0, "first"), ("Y", 1, "second")], "key string, id int, description string")
    papers = spark.createDataFrame([(1, ["a", "b", "q"]), (2, [])], "paper_id bigint, Abstract array<string>")
    got = models.prefix_predictions(papers, known, bank, lambda: lambda x: x.sum(axis=1), 2, n_steps=4, view_length=2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, "a", "X", "first"), (1, 2, "b", "Y", "second")]
    # Words without a vector give no row; the number counts known words.
    papers = spark.createDataFrame([(1, ["q", "b", "q", "a", "b"]), (2, ["q"])], "paper_id bigint, Abstract array<string>")
    got = models.prefix_predictions(papers, known, bank, lambda: lambda x: x.sum(axis=1), 2, n_steps=4, view_length=4)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, "b", "Y", "second"), (1, 2, "a", "Y", "second")]


def test_prefixes_are_scored_once_and_classes_joined_in_place(spark, sf_dir):
    plan = QUERIES["prefix_predictions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert not any("Exchange hashpartitioning(id#" in line for line in plan.splitlines())


def test_activations(spark):
    row = spark.createDataFrame([([0.0, 1.0, -800.0],)], "z array<double>")
    sig, soft = row.select(arrays.sigmoid(F.col("z")), arrays.softmax(F.col("z"))).first()
    assert sig == pytest.approx([0.5, 1 / (1 + math.exp(-1)), 0.0])
    assert soft == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e), 0.0])
    assert row.select(arrays.identity(F.col("z"))).first()[0] == [0.0, 1.0, -800.0]


def brute_counts(p, y, t):
    guess = (p > t).astype(int)
    for i in range(len(p)):
        if guess[i].sum() == 0:
            guess[i, p[i].argmax()] = 1
    tp, fp, fn = (guess * y).sum(0), (guess * (1 - y)).sum(0), ((1 - guess) * y).sum(0)
    return guess, tp, fp, fn


def brute_f(tp, fp, fn, beta):
    bottom = (1 + beta**2) * tp + beta**2 * fn + fp
    return np.where(bottom > 0, (1 + beta**2) * tp / np.maximum(bottom, 1), 0.0)


def frame(spark, p, y):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(p, y))], "row_id bigint, p array<double>, y array<int>")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.sampled_from([0.5, 1.0, 2.0]))
def test_thresholds_equal_brute_force(spark, seed, beta):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, 50, (12, 4)) / 49  # many scores sit exactly on the grid
    y = rng.integers(0, 2, (12, 4))
    df = frame(spark, p, y)
    grid = [k / 49 for k in range(50)]
    table = np.array([brute_f(*brute_counts(p, y, t)[1:], beta) for t in grid]).round(12)
    fitted = {r["class_id"]: r for r in thresholds.fit_thresholds(df, beta=beta).collect()}
    for c in range(4):
        assert fitted[c]["threshold"] == grid[table[:, c].argmax()]
        assert fitted[c]["f_beta"] == pytest.approx(table[:, c].max())
    coarse = [k / 29 for k in range(30)]
    curve = np.array([brute_f(*brute_counts(p, y, t)[1:], 1.0).mean() for t in coarse]).round(12)
    best = thresholds.fit_single_threshold(df).first()
    assert best["threshold"] == coarse[curve.argmax()] and best["f1"] == pytest.approx(curve.max())


def test_predict_and_metrics(spark):
    p = np.array([[0.1, 0.15, 0.05], [0.5, 0.3, 0.2], [0.1, 0.1, 0.1], [0.0, 0.9, 0.3]])
    y = np.array([[1, 0, 0], [1, 1, 0], [0, 0, 1], [0, 1, 0]])
    df = frame(spark, p, y)
    got = [r["y_hat"] for r in thresholds.predict_thresholds(df).orderBy("row_id").collect()]
    guess, tp, fp, fn = brute_counts(p, y, 0.2)
    assert got == guess.tolist()
    raw = thresholds.predict_thresholds(df, [0.4, 0.4, 0.05], fill=False).orderBy("row_id").collect()
    assert [r["y_hat"] for r in raw] == (p > [0.4, 0.4, 0.05]).astype(int).tolist()
    by_class = metrics.fbeta_by_class(thresholds.predict_thresholds(df))
    assert [r["f_beta"] for r in by_class.orderBy("class_id").collect()] == pytest.approx(list(brute_f(tp, fp, fn, 1.0)))
    assert metrics.mean_fbeta(by_class).first()[0] == pytest.approx(brute_f(tp, fp, fn, 1.0).mean())
    assert metrics.quadratic_cost(df).first()[0] == pytest.approx(0.5 * ((p - y) ** 2).sum(axis=0).mean())
    labelled = df.withColumn("label", F.lit(1))
    exact = np.mean([np.log(np.exp(r).sum()) - r[1] for r in p])
    assert metrics.cross_entropy(labelled).first()[0] == pytest.approx(exact)
    assert metrics.top_k_accuracy(labelled, 1).first()[0] == 0.75
    assert metrics.top_k_label_mass(df, 1).first()[0] == pytest.approx(0.5)
    weights = spark.createDataFrame([(1.0,), (2.0,)], "w double")
    assert metrics.l2_penalty(weights, 0.5, 10).first()[0] == pytest.approx(0.125)
