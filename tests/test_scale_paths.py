"""Whole jobs give the same result when nothing may be broadcast whole, for any partitioning."""

import pytest
from pyspark.sql import functions as F

from doclabel.operators import lookup, models
from doclabel.plans.corpus import process_corpus
from suite import fixtures as fx


def snapshot(papers):
    return sorted((r["paper_id"], tuple(r["MSCs"]), tuple(r["Abstract"])) for r in papers.collect())


@pytest.fixture(scope="module")
def baseline(spark, sf_dir):
    result = process_corpus(fx.papers(spark, sf_dir), fx.bank(spark), fx.TAGGER, fx.DEPTH)
    return snapshot(result.papers), sorted(map(tuple, result.vocab.collect()))


def test_large_vocabulary_path(spark, sf_dir, baseline, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 40_000)
    monkeypatch.setattr(lookup, "SAMPLE", 0.5)
    result = process_corpus(fx.papers(spark, sf_dir), fx.bank(spark), fx.TAGGER, fx.DEPTH)
    assert "_flags" in result.papers._jdf.queryExecution().toString()  # the vocabulary came in blocks
    assert (snapshot(result.papers), sorted(map(tuple, result.vocab.collect()))) == baseline


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_result_is_independent_of_partitioning(spark, sf_dir, baseline, parts):
    raw = fx.papers(spark, sf_dir).repartition(parts, F.xxhash64("paper_id", F.lit(parts)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        result = process_corpus(raw, fx.bank(spark), fx.TAGGER, fx.DEPTH)
        assert (snapshot(result.papers), sorted(map(tuple, result.vocab.collect()))) == baseline
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_word_fills_a_third_of_the_corpus(spark, monkeypatch):
    lists = [["hot"] * 40 + [f"w{i % 9}", f"w{(i + 4) % 9}"] for i in range(60)]
    docs = spark.createDataFrame([(i, w, ["X"] if i % 3 else ["Y"]) for i, w in enumerate(lists)], "paper_id bigint, Abstract array<string>, MSCs array<string>")
    vocab = spark.createDataFrame([("hot", 0)] + [(f"w{i}", i + 1) for i in range(9)], "key string, id bigint")
    bank = spark.createDataFrame([("X", 0, ""), ("Y", 1, "")], "key string, id int, description string")
    model = models.train_unigram(docs, vocab, bank)

    def scored():
        return {r["paper_id"]: [round(x, 12) for x in r["p"]] for r in models.class_scores(docs, model, vocab).collect()}

    plain = scored()
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 300)
    assert scored() == plain and len(plain) == 60


def test_word_lists_are_not_shuffled_by_class(spark, sf_dir):
    from suite.queries import QUERIES

    for name in ("label_word_counts", "train_unigram"):
        text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(MSCs" not in text and "hashpartitioning(code" not in text
