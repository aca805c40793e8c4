import pytest
from pyspark.sql import functions as F

from doclabel import staging
from doclabel.operators import models, thresholds
from doclabel.plans.stages import AbstractCleaner, ColumnSelector, VocabSelector
from doclabel.plans.corpus import tag_by
from doclabel.sources import containers, harvest, tables
from doclabel.streaming import jobs

PAGE = """<?xml version="1.0" encoding="UTF-8"?>
<OAI-PMH><ListRecords>
<record><header><datestamp>2012-03-04</datestamp></header><metadata><arXiv>
 <id>1203.{n}</id><title>On rings</title>
 <authors><author><keyname>Doe</keyname><forenames>J</forenames></author><author><keyname>Solo</keyname></author></authors>
 <msc-class>Primary 14B13; Secondary 05C15 (13A10)</msc-class><abstract> We study $x$ rings. </abstract></arXiv></metadata></record>
<record><header><datestamp>2014-01-01</datestamp></header><metadata><arXiv>
 <id>1401.0001</id><authors><author><keyname>Roe</keyname><forenames>A</forenames></author></authors><abstract>None</abstract></arXiv></metadata></record>
</ListRecords></OAI-PMH>"""


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    for n in range(5):
        (folder / f"page{n}.xml").write_text(PAGE.replace("{n}", f"000{n}"))
    return str(folder)


def test_xml_records(spark, pages):
    records = harvest.read_oai_records(spark, pages)
    assert records.columns == list(harvest.COLUMNS) and records.count() == 10
    one = harvest.harvest_union(records)
    assert one.count() == 6
    first = one.filter("arXiv_id = '1203.0000'").first()
    assert first["Authors"] == "Doe,J|Solo," and first["MSCs"] == "14B13|05C15|13A10"
    assert first["Date"] == "2012-03-04" and first["Abstract"] == " We study $x$ rings. "
    other = one.filter("arXiv_id = '1401.0001'").first()
    assert other["Title"] == "" and other["MSCs"] == "" and other["Authors"] == "Roe,A"
    assert harvest.harvest_range(one, "2013-01-01").count() == 1
    assert harvest.harvest_range(one).count() == 6
    latest = harvest.harvest_union(records, latest="Date")
    assert latest.count() == 6 and latest.columns == list(harvest.COLUMNS)


@pytest.mark.parametrize("day", ["2012-3-4", "04-03-2012", "2012-13-01", "x"])
def test_bad_days(spark, day):
    with pytest.raises(ValueError):
        harvest.check_day(day)


def test_raw_and_processed_tables(spark, tmp_path):
    missing = tables.read_raw_columns(spark, str(tmp_path / "nothing"))
    assert missing.columns == ["Abstract", "MSCs"] and missing.count() == 0
    path = str(tmp_path / "raw")
    spark.createDataFrame([("t", "05C15|14B13|05A01", 1)], "Abstract string, MSCs string, n int").write.parquet(path)
    assert tables.read_raw_columns(spark, path).columns == ["Abstract", "MSCs"]
    assert tables.load_processed(spark, path).first()["MSCs"] == "05C15|14B13|05A01"
    table = str(tmp_path / "training")
    for depth in (2, 3):
        tables.save_training_set(spark.createDataFrame([(depth,)], "d int"), table, "rnn", depth)
    assert [r["d"] for r in tables.load_training_set(spark, table, "rnn", 3).collect()] == [3]


def test_label_bank(spark, tmp_path):
    bank = containers.load_label_bank(spark, 2)
    assert bank.count() == 61 and bank.filter("id = 0").first()["key"] == "03"
    path = str(tmp_path / "bank")
    containers.save_label_bank(bank, path)
    assert sorted(containers.load_label_bank(spark, path).collect()) == sorted(bank.collect())
    assert containers.load_label_bank(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        containers.load_label_bank(spark, 4)


def test_containers_and_models_round_trip(spark, tmp_path):
    vocab = spark.createDataFrame([("null", 1, "NN", 3), ("b", 0, "JJ", 4)], "key string, id bigint, tag string, freq bigint")
    containers.save_container(vocab, str(tmp_path / "v"))
    assert [r["key"] for r in containers.load_container(spark, str(tmp_path / "v")).collect()] == ["b", "null"]
    fitted = spark.createDataFrame([(1, 0.5, "y"), (0, 0.25, "x")], "class_id int, threshold double, label string")
    containers.save_table(fitted, str(tmp_path / "t"))
    assert containers.load_thresholds(spark, str(tmp_path / "t")) == [0.25, 0.5]
    bank = spark.createDataFrame([("X", 0, "")], "key string, id int, description string")
    docs = spark.createDataFrame([(["b", "b"], ["X"])], "Abstract array<string>, MSCs array<string>")
    containers.save_unigram(models.train_unigram(docs, vocab, bank), vocab, str(tmp_path / "u"))
    model, again = containers.load_unigram(spark, str(tmp_path / "u"))
    assert again.count() == 2 and model.topics().first()["p"] == pytest.approx(3 / 4)
    emb = spark.createDataFrame([([0.0], 0), ([1.0], 1)] * 5, "vector array<double>, y int")
    containers.save_ml_model(models.train_mlp(emb, [2], 1, 2, max_iter=5), str(tmp_path / "m"))
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel

    assert MultilayerPerceptronClassificationModel.load(str(tmp_path / "m")).numClasses == 2


def test_scratch_folder_comes_from_the_session(spark):
    assert staging.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = staging.stage(spark.range(5), "t")
    assert staging.scratch_dir(spark) in staged.inputFiles()[0] and staged.count() == 5


def test_stages(spark):
    papers = spark.createDataFrame([(1, "red car red car"), (2, "red car blue car")], "paper_id bigint, Abstract string")
    cleaned = AbstractCleaner().transform(ColumnSelector(columns=["paper_id", "Abstract"]).transform(papers))
    model = VocabSelector(tag_by("CASE WHEN word = 'blue' THEN 'RB' ELSE 'NNP' END"), share=1.0).fit(cleaned)
    assert {"red", "blue"} & {r["key"] for r in model.vocab.collect()} == set()
    frequent = spark.createDataFrame([(i, "red car bus") for i in range(4)], "paper_id bigint, Abstract string")
    model = VocabSelector(tag_by("'NNP'"), share=1.0).fit(AbstractCleaner().transform(frequent))
    words = model.transform(AbstractCleaner().transform(frequent)).first()["Abstract"]
    assert words[0] == "red" and "car" in words


def test_stream_ingest_keeps_each_paper_once(spark, tmp_path):
    landed = str(tmp_path / "landed")
    for page in range(4):
        rows = [(i, f"text {i}") for i in range(page * 5, page * 5 + 8)]
        df = spark.createDataFrame(rows, "paper_id bigint, Abstract string").withColumn("ts", F.timestamp_seconds(F.col("paper_id") * 60 + 1_700_000_000))
        df.coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(landed)
        jobs.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["paper_id"] for r in got.collect()) == list(range(23))


def test_late_pages_and_late_copies(spark, tmp_path):
    """An old page comes three batches late, a copy a year later; every id is kept once."""
    landed, day = str(tmp_path / "landed"), lambda ids, start: [(i, f"text {i}", start + k) for k, i in enumerate(ids)]
    pages = [day(range(0, 5), 200), day(range(3, 8), 300), day(range(8, 10), 500), day(range(10, 15), 0), day([0, 14], 900)]
    for page in pages:
        df = spark.createDataFrame(page, "paper_id bigint, Abstract string, day int").withColumn("ts", F.timestamp_seconds(F.col("day") * 86_400))
        df.coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(landed)
        jobs.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["paper_id"] for r in got) == list(range(15))
    assert {r["day"] for r in got if r["paper_id"] in (0, 14)} == {200, 4}


def test_stream_of_xml_pages(spark, pages, tmp_path):
    stream = harvest.stream_oai_records(spark, pages, maxFilesPerTrigger="2")
    jobs.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), "arXiv_id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_stream_label_equals_batch(spark, tmp_path):
    papers = spark.createDataFrame([(i, f"alpha beta {'gamma' if i % 2 else 'delta'} end") for i in range(12)], "paper_id bigint, Abstract string")
    vocab = spark.createDataFrame([(w, i, "NN", 5) for i, w in enumerate(["alpha", "beta", "gamma", "delta"])], "key string, id bigint, tag string, freq bigint")
    bank = spark.createDataFrame([("X", 0, ""), ("Y", 1, "")], "key string, id int, description string")
    docs = spark.createDataFrame([(["alpha", "gamma"], ["X"]), (["beta", "delta", "delta"], ["Y"])], "Abstract array<string>, MSCs array<string>")
    scorer = models.prepare_scorer(models.train_unigram(docs, vocab, bank), vocab)
    batch = jobs.label_papers(papers, scorer, vocab, 0.55)
    landed = str(tmp_path / "landed")
    papers.repartition(4).write.parquet(landed)
    stream = spark.readStream.schema(papers.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    jobs.stream_label(stream, scorer, vocab, str(tmp_path / "out"), str(tmp_path / "state"), 0.55).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("paper_id", "p", "y_hat")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert thresholds.DEFAULT_THRESHOLD == 0.2
