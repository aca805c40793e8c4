"""What must not grow with a keyed table, a stream's batches or the texts."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from doclabel import staging
from doclabel.operators import dictionary, lookup, models, phrases, scores
from doclabel.plans import features, training
from doclabel.streaming import jobs
from suite import fixtures as fx

WORDS = ["", "a", "b", "ab", "ba", "é", "x" * 300_000, "x" * 299_999, *(f"w{i}" for i in range(500))]


def asked():
    draw = np.random.default_rng(3)
    return pa.array([*draw.choice(WORDS[:5] + WORDS[8:], 2000).tolist(), "x" * 300_000, "no", None, "w1_", None])


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_places_do_not_index_the_keys_again(monkeypatch, kind):
    keys = pa.array([w for i, w in enumerate(WORDS) if i % 3] + [None, "a"], pa.string())
    block = dictionary.Block.of(pa.table({"key": keys, "id": pa.array(range(len(keys)), pa.int64())}))
    items = asked().cast(kind).slice(5)
    wanted = [None if w is None else i for w, i in ((w, pc.index_in(pa.scalar(w, pa.string()), value_set=keys).as_py()) for w in items.to_pylist())]
    hashed, plain = [], dictionary.hashes_of
    monkeypatch.setattr(dictionary, "hashes_of", lambda words: hashed.append(len(words)) or plain(words))
    monkeypatch.setattr(pc, "index_in", None)  # it makes a hash table of all keys at every call
    places = block.places(items)
    ids = block.columns["id"].to_pylist()
    assert [None if p < 0 else ids[p] for p in places] == wanted
    assert hashed == [len(items.drop_null().unique())]  # the distinct words of the texts, not the keys


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(dictionary, "hashes_of", lambda words: np.zeros(len(words), np.uint64))
    block = dictionary.Block.of(pa.table({"key": pa.array(["a", "b", "c"]), "id": pa.array([4, 5, 6])}))
    assert [block.columns["id"][p].as_py() if p >= 0 else None for p in block.places(pa.array(["c", "d", "a", "c"]))] == [6, None, 4, 6]


def test_no_keys():
    block = dictionary.Block.of(pa.table({"key": pa.array([], pa.string())}))
    assert block.places(asked()).max() == -1 and len(block.places(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("bound", [1 << 20, 1])
def test_kept_words(spark, monkeypatch, bound):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", bound)
    lists = [(1, ["a", "b", "c", "a"]), (1, None), (None, []), (4, ["zz", None]), (5, ["c"] * 2000)]
    df = spark.createDataFrame(lists, "_ids bigint, Abstract array<string>").repartition(2)
    keyed = spark.createDataFrame([("a",), ("c",)], "key string")
    found = dictionary.kept_words(df, keyed, "Abstract")
    assert found.schema == df.schema
    kept = sorted(((r[0] or 0, tuple(r[1])) for r in found.collect()))
    assert kept == [(0, ()), (1, ()), (1, ("a", "c", "a")), (4, ()), (5, ("c",) * 2000)]


def test_stream_sends_vocabulary_and_model_once(spark, tmp_path, monkeypatch):
    papers = spark.createDataFrame([(i, ["alpha", "beta"] * (1 + i % 3), ["X"] if i % 2 else ["Y"]) for i in range(12)], "paper_id bigint, Abstract array<string>, MSCs array<string>")
    vocab = spark.createDataFrame([("alpha", 0), ("beta", 1)], "key string, id bigint")
    bank = spark.createDataFrame([("X", 0, ""), ("Y", 1, "")], "key string, id int, description string")
    scorer = models.prepare_scorer(models.train_unigram(papers, vocab, bank), vocab)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 60)  # several blocks each
    texts = papers.select("paper_id", F.concat_ws(" ", "Abstract").alias("Abstract"))
    texts.repartition(4, "paper_id").write.parquet(f"{tmp_path}/in")
    made, plain = [], dictionary.Block.of
    monkeypatch.setattr(dictionary.Block, "of", lambda table: made.append(len(table)) or plain(table))
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.stream_label(stream, scorer, vocab, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    batches = spark.read.parquet(f"{tmp_path}/out")
    assert batches.select("batch").distinct().count() > 1 and batches.count() == 12
    assert sum(made) == 4  # two words in the vocabulary, two in the model
    whole = jobs.label_papers(texts, scorer, vocab)
    assert sorted(map(tuple, batches.select("paper_id", "p").collect())) == sorted(map(tuple, whole.select("paper_id", "p").collect()))


def test_document_vectors_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def made(i):
        calls.add(1)
        return [float(i)]

    ids = spark.range(5000, numPartitions=3).select(F.col("id").alias("paper_id"), F.array(F.lit("X")).alias("MSCs"))
    bank = spark.createDataFrame([("X", 0, "")], "key string, id int, description string")
    split = training.t2v_training_set(ids.withColumn("vector", made.asNondeterministic()("paper_id")), bank)
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 4000, "test": 500, "validation": 500} and calls.value == 5000


def test_saved_pages_are_files_of_bounded_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fx, "PAGE_BYTES", 20_000)
    monkeypatch.setattr(fx, "_stored", {})
    pages = fx.cumulative_pages(spark, sf_dir).removesuffix("*")
    texts = fx.table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0]
    for page in (1, 2, 3):
        files = spark.read.format("binaryFile").load(f"{pages}{page}").select("length").collect()
        assert len(files) >= texts * page / 3 / 20_000 > 4


def counting(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(n):
        calls.add(1)
        return n

    return calls, seen.asNondeterministic()


def test_class_counts_are_made_once(spark):
    calls, seen = counting(spark)
    papers = spark.createDataFrame([(i, ["alpha", "beta"], ["X"]) for i in range(20)], "paper_id bigint, Abstract array<string>, MSCs array<string>")
    vocab = spark.createDataFrame([("alpha", 0), ("beta", 1)], "key string, id bigint")
    bank = spark.createDataFrame([("X", 0, "")], "key string, id int, description string")
    model = models.train_unigram(papers.withColumn("paper_id", seen("paper_id")).filter("paper_id >= 0"), vocab, bank)
    scorer = models.prepare_scorer(model, vocab)
    assert calls.value == 20 and scorer.smoothing == [42.0]
    assert sorted((r["key"], r["n"]) for r in model.cells.collect()) == [("alpha", 20), ("beta", 20)] and calls.value == 20


def test_tf_idf_parts_count_cells_once(spark):
    calls, seen = counting(spark)
    cells = spark.createDataFrame([(i, label, 1 + i) for i in range(10) for label in (0, 1)], "id bigint, label int, n bigint")
    vocab = spark.createDataFrame([(f"w{i}", i, "NN") for i in range(11)], "key string, id bigint, tag string")
    parts = {r["id"]: r for r in scores.tf_idf_parts(cells.withColumn("n", seen("n")), vocab, 2).collect()}
    assert calls.value == 20 and parts[9]["tf_sum"] == 2.0 and parts[10]["doc_freq"] == 0


def test_gain_counts_only_words_of_the_vocabulary(spark, monkeypatch):
    texts = spark.createDataFrame([("x", "a b c a b"), ("y", "a d b"), ("y", None), (None, "a b a")], "label string, Abstract string")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("a_b", 2), ("zz", 3)], "key string, id bigint")
    met = []
    monkeypatch.setattr(scores, "information_gain", lambda docs, cells, *_: met.append(cells) or cells)
    features.information_gain(texts, vocab)
    assert sorted(((r["id"], r["label"] or "", r["n"]) for r in met[0].collect())) == [(0, "", 1), (0, "x", 2), (0, "y", 1), (1, "", 1), (1, "x", 1), (2, "", 1), (2, "x", 2)]
    plan = met[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("MapInArrow")  # looked up before words are counted and shuffled


def written(monkeypatch):
    """Names of the tables written to the scratch folder from now on."""
    names, plain = [], staging.scratch_path
    monkeypatch.setattr(staging, "scratch_path", lambda spark, name: names.append(name) or plain(spark, name))
    return names


SMALL = [(i, ["alpha", "beta", "gamma"] * (1 + i % 3), ["X"] if i % 2 else ["Y", "X", "Y", "?"]) for i in range(12)]


def small(spark):
    papers = spark.createDataFrame(SMALL, "paper_id bigint, Abstract array<string>, MSCs array<string>")
    vocab = spark.createDataFrame([("alpha", 0), ("beta", 1), ("gamma", 5)], "key string, id bigint")
    return papers, vocab, spark.createDataFrame([("X", 0, ""), ("Y", 1, "")], "key string, id int, description string")


@pytest.mark.parametrize("mode", ["linear", "log"])
def test_scoring_by_blocks_writes_no_texts(spark, monkeypatch, mode):
    papers, vocab, bank = small(spark)
    scorer = models.prepare_scorer(models.train_unigram(papers, vocab, bank), vocab, mode)
    whole = models.score_classes(papers, scorer).collect()
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 30)  # several blocks
    names = written(monkeypatch)
    for a, b in zip(sorted(models.score_classes(papers, scorer).collect()), sorted(whole), strict=True):
        assert a["paper_id"] == b["paper_id"] and a["p"] == pytest.approx(b["p"])
    assert names == []


def test_scorer_holds_narrow_numbers(spark):
    papers, vocab, bank = small(spark)
    scorer = models.prepare_scorer(models.train_unigram(papers, vocab, bank), vocab, "log")
    assert dict(scorer.by_word.dtypes) == {"key": "string", "labels": "array<tinyint>", "gains": "array<int>"}
    assert scorer.size == sum(16 + len(k) + 2 * (1 + 4) for k in ("alpha", "beta", "gamma"))


def test_stream_by_blocks_writes_only_its_batches(spark, tmp_path, monkeypatch):
    papers, vocab, bank = small(spark)
    scorer = models.prepare_scorer(models.train_unigram(papers, vocab, bank), vocab)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 30)
    texts = papers.select("paper_id", F.concat_ws(" ", "Abstract").alias("Abstract"))
    texts.repartition(3, "paper_id").write.parquet(f"{tmp_path}/in")
    names = written(monkeypatch)
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.stream_label(stream, scorer, vocab, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert names == [] and spark.read.parquet(f"{tmp_path}/out").count() == 12


@pytest.mark.parametrize("held", [1, 1 << 23])
def test_class_counts_shuffle_numbers(spark, monkeypatch, held):
    monkeypatch.setattr(models, "HELD", held)
    papers, vocab, bank = small(spark)
    odd = [(20, None, ["X"]), (21, ["alpha"], None), (22, [], ["X"]), (23, ["zz", None, "beta"], ["Y"]), (24, ["alpha"], ["?"])]
    plans = []
    monkeypatch.setattr(models, "stage", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    model = models.train_unigram(papers.unionByName(spark.createDataFrame(odd, papers.schema)), vocab, bank)
    want = {}
    for _, words, codes in SMALL + odd:
        for code in codes or []:
            for word in words or []:
                if code != "?" and word in ("alpha", "beta", "gamma"):
                    want[code, word] = want.get((code, word), 0) + 1
    ids = {"X": 0, "Y": 1, "alpha": 0, "beta": 1, "gamma": 5}
    assert {tuple(r) for r in model.cells.collect()} == {(ids[c], ids[w], w, n) for (c, w), n in want.items()}
    assert [t for _, t in model.cells.dtypes] == ["int", "bigint", "string", "bigint"]
    assert "Generate" not in plans[0]  # no row of its own for a word


@pytest.mark.parametrize("dense", [1, 600, 1 << 20])
@pytest.mark.parametrize("bound", [600, 1 << 20])
def test_wide_and_narrow_rows_are_added_alike(spark, monkeypatch, dense, bound):
    monkeypatch.setattr(dictionary, "DENSE_BYTES", dense)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", bound)
    draw = np.random.default_rng(1)
    rows = {f"w{i}": {int(c): float(draw.integers(1, 9)) / 4 for c in draw.choice(12, i % 13, replace=False)} for i in range(20)}
    lists = [(i, [f"w{k}" for k in draw.integers(0, 25, int(draw.integers(0, 40)))]) for i in range(30)] + [(30, None)]
    keyed = spark.createDataFrame([(k, list(v), list(v.values())) for k, v in rows.items()], "key string, labels array<int>, gains array<double>")
    df = spark.createDataFrame(lists, "paper_id bigint, Abstract array<string>").coalesce(1)
    got = sorted((r["paper_id"], r["sums"]) for r in dictionary.added_gains(df, keyed, "paper_id", "Abstract", 12).collect())
    assert got == [(i, [float(sum(w in rows for w in ws or []))] + [sum(rows.get(w, {}).get(c, 0.0) for w in ws or []) for c in range(12)]) for i, ws in lists]


def test_phrases_leave_no_pairs_behind(spark, monkeypatch):
    paths, plain = [], staging.scratch_path
    monkeypatch.setattr(staging, "scratch_path", lambda spark, name: paths.append(plain(spark, name)) or paths[-1])
    texts = spark.createDataFrame([(i, ["a", "b", "c", "d", "a", "b"][i % 3 :]) for i in range(40)], "paper_id bigint, Abstract array<string>")
    vocab = staging.stage(spark.createDataFrame([(w, i, "NN", 9) for i, w in enumerate("abcd")], "key string, id bigint, tag string, freq bigint"), "vocab")
    found = phrases.build_phrases(texts, vocab)
    left = [p for p in paths if Path(p).exists()]
    assert len(left) == 2 and left[0] == paths[0] and left[1] == paths[-1]  # what was given, and what the result reads
    assert len(paths) > 5 and found.count() == 2 and vocab.count() == 4


def test_a_result_keeps_what_it_reads(spark):
    outer = []

    @staging.passing
    def inner(df):
        first = staging.stage(df, "first")
        outer.append(first)
        return staging.stage(first.filter("id > 2"), "second").union(staging.stage(df, "third"))

    @staging.passing
    def both(df):
        return staging.stage(inner(df), "last")

    kept = inner(spark.range(5))
    assert kept.count() == 7
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        outer[0].count()
    assert both(spark.range(5)).count() == 7
