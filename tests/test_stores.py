"""Stored models, stored stages, records by month, and revisions on a stream."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from doclabel.operators import models
from doclabel.plans import training
from doclabel.plans.corpus import tag_by
from doclabel.plans.stages import CodeCleaner, UsableFilter, VocabModel, VocabSelector
from doclabel.sources import models as store
from doclabel.sources import months
from doclabel.sources.harvest import COLUMNS
from doclabel.streaming import jobs

BANK = [("X", 0, ""), ("Y", 1, "")]
VOCAB = [("a", 0), ("b", 1)]
DOCS = [(1, ["a", "b"], ["X"]), (2, ["b"], ["Y", "X"]), (3, ["c"], ["Y"])]


def record(number, date, title="t"):
    return (f"p{number}", title, "", date, "", "text")


def records(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


def as_set(df):
    return {(r["arXiv_id"], r["Date"], r["Title"]) for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, "paper_id bigint, Abstract array<string>, MSCs array<string>")
    return docs, spark.createDataFrame(VOCAB, "key string, id bigint"), spark.createDataFrame(BANK, "key string, id int, description string")


def test_models_predict_the_same_after_loading(spark, tables, tmp_path):
    docs, vocab, bank = tables
    unigram = store.StoredUnigram(models.train_unigram(docs, vocab, bank), vocab)
    emb = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(20)], "vec_id int, vector array<double>, y int")
    network = store.StoredML(models.train_mlp(emb, [2], 2, 2, max_iter=5))
    thresholds = store.StoredThresholds(spark.createDataFrame([(1, 0.5, "b"), (0, 0.25, "a")], "class_id int, threshold double, label string"))
    scored = spark.createDataFrame([(1, [0.3, 0.4]), (2, [0.1, 0.9])], "row_id int, p array<double>")
    for model, rows, arguments in ((unigram, docs, {}), (network, emb, {"features": "vector"}), (network, emb.limit(3), {"features": "vector"}), (thresholds, scored, {})):
        path = str(tmp_path / type(model).__name__)
        store.save_model(spark, model, path)  # the third time over the second one
        again = store.load_model(spark, path)
        assert type(again) is type(model)
        assert sorted(map(str, again.predict(rows, **arguments).collect())) == sorted(map(str, model.predict(rows, **arguments).collect()))
    vectors = store.StoredVectors(spark.createDataFrame([("a", [1.0])], "word string, vector array<float>"))
    store.save_model(spark, vectors, str(tmp_path / "v"))
    assert store.load_model(spark, str(tmp_path / "v")).table.collect() == vectors.table.collect()


def test_a_folder_without_manifest_is_no_model(spark, tables, tmp_path):
    with pytest.raises(TypeError):
        store.save_model(spark, object(), str(tmp_path / "x"))
    tables[1].write.parquet(str(tmp_path / "y" / "cells"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.load_model(spark, str(tmp_path / "y"))


def test_a_pipeline_of_stages_is_a_model_of_the_store(spark, tables, tmp_path):
    docs, vocab, bank = tables
    stages = [CodeCleaner(bank, 2), VocabModel(vocab), UsableFilter(minWords=1)]
    model = store.StoredML(PipelineModel(stages))
    store.save_model(spark, model, str(tmp_path / "p"))
    again = store.load_model(spark, str(tmp_path / "p"))
    assert [s.uid for s in again.model.stages] == [s.uid for s in stages]
    assert sorted(map(str, again.predict(docs).collect())) == sorted(map(str, model.predict(docs).collect()))
    assert {r["paper_id"]: r["Abstract"] for r in again.predict(docs).collect()} == {1: ["a"]}


def test_selectors_with_and_without_a_rule(tmp_path):
    rule = VocabSelector(tag_rule="'NNP'", share=0.5, words="w")
    rule.save(str(tmp_path / "s"))
    again = VocabSelector.load(str(tmp_path / "s"))
    assert [again.getOrDefault(p) for p in (again.tagRule, again.share, again.wordsCol)] == ["'NNP'", 0.5, "w"]
    with pytest.raises(ValueError):
        VocabSelector(tag_by("'NNP'")).save(str(tmp_path / "t"))


def test_only_folders_of_the_range_are_read(spark, tmp_path):
    path = str(tmp_path / "months")
    rows = [record(i, f"2011-{i % 12 + 1:02d}-1{i % 9}") for i in range(60)] + [record(99, "")]
    months.write_months(records(spark, rows), path)
    found = months.read_range(spark, path, "2011-03-05", "2011-04-12")
    assert as_set(found) == {(r[0], r[3], "t") for r in rows if "2011-03-05" <= r[3] <= "2011-04-12"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    read = {f.rsplit("month=", 1)[1][:7] for f in found.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert read == {"2011-03", "2011-04"}
    assert as_set(months.read_range(spark, path)) == {(r[0], r[3], "t") for r in rows if r[3]}
    with pytest.raises(ValueError):
        months.read_range(spark, path, "2011-3-5")


def test_new_pages_rewrite_few_months(spark, tmp_path):
    path = str(tmp_path / "months")
    months.write_months(records(spark, [record(1, "2011-01-05"), record(2, "2011-02-01"), record(3, "2011-05-01"), record(4, "")]), path)
    files_of = lambda month: [f for f in months.read_months(spark, path).inputFiles() if f"month={month}" in f]
    kept = files_of("2011-05")
    page = records(spark, [record(1, "2011-03-01", "new"), record(2, "2010-12-31", "old"), record(5, "2011-03-09"), record(5, "2011-03-09"), record(4, "2011-03-07")])
    assert months.add_pages(page, path) == ["2010-12", "2011-01", "2011-02", "2011-03", "none"]
    assert as_set(months.read_months(spark, path)) == {
        ("p1", "2011-03-01", "new"), ("p2", "2011-02-01", "t"), ("p3", "2011-05-01", "t"), ("p4", "2011-03-07", "t"), ("p5", "2011-03-09", "t")}
    assert months.read_months(spark, path).count() == 5
    assert files_of("2011-05") == kept and not files_of("2011-01")


def test_revisions_in_any_order_and_after_a_restart(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / x) for x in ("landing", "out", "checkpoint"))
    pages = [
        [record(1, "2011-01-02", "second"), record(2, "2011-01-01")],
        [record(1, "2011-01-01", "first"), record(2, "2011-01-01")],
        [record(1, "2011-01-03", "third"), record(3, "2011-01-01"), record(3, "2011-01-01")],
    ]
    for number, rows in enumerate(pages):
        records(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(records(spark, rows).schema).parquet(landing)
        jobs.stream_revisions(stream, out, checkpoint).awaitTermination()
        if number == 1:
            assert as_set(jobs.current_records(spark, out)) == {("p1", "2011-01-02", "second"), ("p2", "2011-01-01", "t")}
    assert as_set(jobs.current_records(spark, out)) == {("p1", "2011-01-03", "third"), ("p2", "2011-01-01", "t"), ("p3", "2011-01-01", "t")}
    assert jobs.current_records(spark, out).count() == 3
    assert spark.read.parquet(out).count() == 4  # what was no news was not written


def test_sequences_with_all_codes(spark, tables):
    docs, _, bank = tables
    vectors = spark.createDataFrame([("a", [1.0])], "word string, vector array<float>")
    rows = training.rnn_training_set(docs, vectors, bank, 1, 3, primary=False).collect()
    assert {r["paper_id"]: (r["y"], r["effective_length"]) for r in rows} == {1: ([1, 0], 1), 2: ([1, 1], 0), 3: ([0, 1], 0)}
