"""One query per operator, each with SQL for the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclabel.functions import arrays, codes, text
from doclabel.operators import labels, metrics, models, phrases, scores, skipgram, splits, subspace, thresholds, tokens, vectors, vocab
from doclabel.operators.dictionary import known_ids
from doclabel.operators.ordering import with_dense_id
from doclabel.plans import experiments, features, training
from doclabel.plans.corpus import build_phrase_vocab, process_corpus
from doclabel.plans.stages import AbstractCleaner, CodeCleaner, ColumnSelector, UsableFilter, VocabSelector
from doclabel.sources import containers, harvest, months, tables
from doclabel.sources import models as model_store
from doclabel.staging import scratch_path, spread, stage
from doclabel.streaming import jobs
from suite import fixtures as fx
from suite import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = o.sql(sql)
        return run

    return register


def joined(column, by: str = " "):
    return F.array_join(column, by)


def rounded(column, alias: str, digits: int = 6):
    return F.round(column, digits).alias(alias)


def numbers(column):
    """An array of numbers as text."""
    return F.array_join(F.transform(column, lambda x: x.cast("int").cast("string")), ",")


SEQUENCE_SQL = """SELECT t.paper_id, t.pos, v.vector, row_number() OVER (PARTITION BY t.paper_id ORDER BY t.pos) - 1 AS step
  FROM tok t JOIN word_vectors v ON v.word = t.word WHERE t.pos < 50"""


def logits_sql(sequence: str, by: str) -> str:
    """Mean vector of each sequence times the fixed matrix: ``(by, c, z)``."""
    return f"""SELECT {by}, c, round(sum(x * ((r * 13 + c * 7) % 101) / 101.0), 9) AS z FROM (
        SELECT {by}, r, avg(x) AS x FROM (SELECT {by}, unnest(range(8)) AS r, unnest(vector)::DOUBLE AS x FROM ({sequence})) GROUP BY {by}, r
      ) CROSS JOIN (SELECT unnest(range(61)) AS c) GROUP BY {by}, c"""


# --- sources and sinks ---------------------------------------------------------

RECORD_COLUMNS = '"arXiv_id", "Title", "Authors", "Date", "MSCs", "Abstract"'


@query("read_oai_records", f"SELECT {RECORD_COLUMNS} FROM records")
def _(spark, d):
    return harvest.read_oai_records(spark, fx.harvest_pages(spark, d))


@query("authors_joined", 'SELECT "arXiv_id", "Authors" FROM records')
def _(spark, d):
    return fx.with_authors(spark, d).select("arXiv_id", codes.join_authors(F.col("authors")).alias("Authors"))


@query(
    "extract_codes",
    r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\d\d\w\d\d'), '|') AS codes FROM documents",
)
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", codes.extract_codes(F.col("text")).alias("codes"))


@query(
    "harvest_range",
    f"""SELECT {RECORD_COLUMNS} FROM records WHERE "Date" BETWEEN '2010-06-01' AND '2012-03-31'""",
)
def _(spark, d):
    records = harvest.read_oai_records(spark, fx.harvest_pages(spark, d))
    return harvest.harvest_range(records, "2010-06-01", "2012-03-31")


REVISED_SQL = """SELECT "arXiv_id", CASE WHEN n % 2 = 0 THEN "Title" || ' (revised)' ELSE "Title" END AS "Title", "Authors",
  CASE WHEN n % 2 = 0 THEN ("Date"::DATE + 400)::DATE::VARCHAR ELSE "Date" END AS "Date", "MSCs", "Abstract"
  FROM (SELECT *, substr("arXiv_id", 6)::INTEGER AS n FROM records)"""


@query("harvest_union", 'SELECT "arXiv_id", "Authors", "MSCs", "Abstract" FROM records')
def _(spark, d):
    # What no page revises is the same in all copies of a record, on one, two or three pages.
    pages = harvest.read_oai_records(spark, fx.cumulative_pages(spark, d))
    return harvest.harvest_union(pages.drop("Title", "Date"))


@query("harvest_union_latest", f"SELECT {RECORD_COLUMNS} FROM ({REVISED_SQL})")
def _(spark, d):
    # Every later page repeats the records before it, some of them revised: the latest date wins.
    return harvest.harvest_union(harvest.read_oai_records(spark, fx.cumulative_pages(spark, d)), latest="Date")


@query("harvest_store_range", f"""SELECT {RECORD_COLUMNS} FROM ({REVISED_SQL}) WHERE "Date" BETWEEN '2010-06-01' AND '2012-03-31'""")
def _(spark, d):
    # The cumulative pages come one after another; revised papers move to later months.
    path = scratch_path(spark, "months")
    pages = fx.cumulative_pages(spark, d).removesuffix("*")
    months.write_months(harvest.read_oai_records(spark, f"{pages}1"), path)
    for page in (2, 3):
        months.add_pages(harvest.read_oai_records(spark, f"{pages}{page}"), path)
    return months.read_range(spark, path, "2010-06-01", "2012-03-31")


@query("stream_revisions", f"SELECT {RECORD_COLUMNS} FROM ({REVISED_SQL})")
def _(spark, d):
    """The last page lands first; the stream stops, starts again and finds older pages with records that are no longer new."""
    out, checkpoint, pages = scratch_path(spark, "revisions"), scratch_path(spark, "revision-state"), fx.cumulative_pages(spark, d)
    for landed in (pages.replace("*", "2"), pages):
        stream = harvest.stream_oai_records(spark, landed, maxFilesPerTrigger="3")
        jobs.stream_revisions(stream, out, checkpoint).awaitTermination()
    return jobs.current_records(spark, out)


def stored_papers(spark, d) -> str:
    path = scratch_path(spark, "raw-papers")
    fx.papers(spark, d).write.parquet(path)
    return path


@query("read_raw_columns", 'SELECT "Abstract", "MSCs" FROM papers')
def _(spark, d):
    return tables.read_raw_columns(spark, stored_papers(spark, d))


CODES_AT_3 = """SELECT paper_id, coalesce(string_agg(code, '|' ORDER BY pos), '') AS codes FROM (
  SELECT paper_id, substr(code, 1, 3) AS code, min(pos) AS pos FROM (
    SELECT paper_id, unnest(string_split("MSCs", '|')) AS code, unnest(range(len(string_split("MSCs", '|')))) AS pos FROM papers)
  GROUP BY paper_id, substr(code, 1, 3)) GROUP BY paper_id"""


@query("load_processed", CODES_AT_3)
def _(spark, d):
    path = scratch_path(spark, "processed")
    labels.as_code_list(fx.papers(spark, d)).write.parquet(path)
    return tables.load_processed(spark, path, depth=3).select("paper_id", joined("MSCs", "|").alias("codes"))


@query(
    "load_label_bank",
    "SELECT b.key, b.id, b.description, count(c.paper_id) AS n_papers FROM bank b LEFT JOIN codes c ON c.code = b.key GROUP BY ALL",
)
def _(spark, d):
    path = scratch_path(spark, "bank")
    containers.save_label_bank(fx.bank(spark), path)
    bank = containers.load_label_bank(spark, path)
    papers = labels.clean_codes(fx.papers(spark, d), bank, 2).select(F.explode("MSCs").alias("key"))
    counts = papers.groupBy("key").agg(F.count("*").alias("n"))
    return bank.join(counts, "key", "left").select(
        "key", "id", "description", F.coalesce("n", F.lit(0)).alias("n_papers")
    )


@query("save_load_container", "SELECT key, id, tag, freq FROM vocab")
def _(spark, d):
    path = scratch_path(spark, "container")
    containers.save_container(fx.vocab(spark, d), path)
    return containers.load_container(spark, path)


TOPICS_SQL = """SELECT label_id, word_id, key, round((n + 1) / total, 9) AS p, round(1.0 / total, 9) AS p_unseen FROM (
  SELECT *, sum(n) OVER (PARTITION BY label_id) + (SELECT count(*) FROM full_vocab) AS total FROM uni_cells)"""


def trained_unigram(spark, d):
    corpus = fx.corpus(spark, d)
    return models.train_unigram(corpus.papers, corpus.vocab, fx.bank(spark))


def topics(model):
    return model.topics().select("label_id", "word_id", "key", rounded("p", "p", 9), rounded("p_unseen", "p_unseen", 9))


@query("save_load_model", TOPICS_SQL)
def _(spark, d):
    path = scratch_path(spark, "unigram")
    containers.save_unigram(trained_unigram(spark, d), fx.corpus(spark, d).vocab, path)
    model, _ = containers.load_unigram(spark, path)
    return topics(model)


@query("save_load_ml", "SELECT vec_id, 10 AS classes, true AS same FROM embeddings")
def _(spark, d):
    """A network predicts the same after it was stored and loaded."""
    emb, model = trained_mlp(spark, d)
    path = scratch_path(spark, "network")
    model_store.save_model(spark, model_store.StoredML(model), path)
    again = model_store.load_model(spark, path).predict(emb, "vector").select("vec_id", F.col("p").alias("q"))
    both = models.predict_mlp(emb, model).join(again, "vec_id")
    return both.select("vec_id", F.size("q").alias("classes"), (F.col("p") == F.col("q")).alias("same"))


@query("save_load_unigram_scores", "SELECT paper_id, label_id, round(p, 6) AS p FROM uni_scores")
def _(spark, d):
    path = scratch_path(spark, "topics")
    model_store.save_model(spark, model_store.StoredUnigram(trained_unigram(spark, d), fx.corpus(spark, d).vocab), path)
    return class_rows(model_store.load_model(spark, path).predict(fx.corpus(spark, d).papers))


@query("load_split", "SELECT paper_id, split FROM split8020")
def _(spark, d):
    path = scratch_path(spark, "training")
    tables.save_training_set(training.unigram_training_set(fx.corpus(spark, d).papers), path, "unigram", 2)
    return tables.load_training_set(spark, path, "unigram", 2).select("paper_id", "split")


@query(
    "demo_examples",
    """SELECT array_to_string(w, ' ') AS sentence, c.codes, b.description FROM words
       JOIN (SELECT paper_id, string_agg(code, '|' ORDER BY pos) AS codes, arg_min(code, pos) AS first FROM codes GROUP BY paper_id) c USING (paper_id)
       JOIN bank b ON b.key = c.first""",
)
def _(spark, d):
    path = scratch_path(spark, "examples")
    papers = labels.primary_label(labels.clean_codes(fx.words(spark, d), fx.bank(spark), 2), fx.bank(spark))
    examples = labels.describe_codes(papers, fx.bank(spark), "code")
    examples.select(F.col("Abstract").alias("sentence"), F.col("MSCs").alias("codes"), "description").write.parquet(path)
    return tables.demo_examples(spark, path).select(
        joined("sentence").alias("sentence"), joined("codes", "|").alias("codes"), "description"
    )


# --- text ------------------------------------------------------------------------


@query("select_column", 'SELECT "MSCs" FROM papers')
def _(spark, d):
    return ColumnSelector(columns=["MSCs"]).transform(fx.papers(spark, d))


def text_query(name: str, function, sql: str):
    @query(name, f'SELECT paper_id, {sql} AS text FROM papers')
    def _(spark, d):
        return fx.raw_texts(spark, d).select("paper_id", function(F.col("Abstract")).alias("text"))


text_query("strip_math", text.strip_math, o.math_free('"Abstract"'))
text_query("strip_non_alphas", text.strip_non_alphas, o.alphas('"Abstract"'))
text_query("clean_text", text.clean_text, o.alphas(o.math_free('"Abstract"')))
text_query(
    "whitespace_words", lambda c: joined(text.whitespace_words(c), "|"),
    f"""array_to_string({o.split_words('"Abstract"')}, '|')""",
)


@query("clean_words", "SELECT paper_id, array_to_string(w, ' ') AS text FROM words")
def _(spark, d):
    cleaned = AbstractCleaner().transform(fx.raw_texts(spark, d))
    return cleaned.select("paper_id", joined("Abstract").alias("text"))


@query(
    "tag_words",
    "SELECT t.paper_id, t.pos, t.word, coalesce(l.tag, 'NN') AS tag FROM tok t LEFT JOIN lexicon l ON l.word = t.word",
)
def _(spark, d):
    lexicon = stage(
        fx.benchmark_words(spark, d).select(F.col("key").alias("word"), F.expr(fx.LEXICON_TAG_SQL.replace("word", "key")).alias("tag")),
        "lexicon",
    )
    tagged = tokens.tag_words(tokens.explode_words(fx.words(spark, d), "paper_id"), lexicon)
    return tagged.select("paper_id", F.col("pos").cast("bigint").alias("pos"), "word", "tag")


@query(
    "select_in_vocab",
    """SELECT w.paper_id, coalesce(s.words, '') AS words FROM words w LEFT JOIN (
       SELECT paper_id, string_agg(key, ' ' ORDER BY p) AS words FROM full_selected GROUP BY paper_id) s ON s.paper_id = w.paper_id""",
)
def _(spark, d):
    chosen = tokens.select_in_vocab(fx.words(spark, d).select("paper_id", "Abstract"), fx.corpus(spark, d).vocab)
    return chosen.select("paper_id", joined("Abstract").alias("words"))


@query(
    "sample_words",
    f"""SELECT p.paper_id, coalesce(s.words, '') AS words FROM papers p LEFT JOIN (
        SELECT paper_id, string_agg(word, ' ' ORDER BY k) AS words FROM ({o.drawn_sql('raw_selected', 25, 7)}) GROUP BY paper_id) s ON s.paper_id = p.paper_id""",
)
def _(spark, d):
    texts = fx.raw_texts(spark, d).select("paper_id", "Abstract")
    drawn = tokens.sample_selected_words(texts, fx.vocab(spark, d).select("key"), 25, 7)
    return drawn.select("paper_id", joined("Abstract").alias("words"))


@query(
    "sigmoid_softmax",
    """SELECT vec_id, i, round(1 / (1 + exp(-x)), 6) AS sig, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS soft
       FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)""",
)
def _(spark, d):
    z = F.col("embedding").cast("array<double>")
    both = F.zip_with(arrays.sigmoid(z), arrays.softmax(z), lambda a, b: F.struct(a.alias("sig"), b.alias("soft")))
    rows = fx.table(spark, d, "embeddings").select("vec_id", F.posexplode(both).alias("i", "v"))
    return rows.select("vec_id", F.col("i").cast("bigint").alias("i"), rounded("v.sig", "sig"), rounded("v.soft", "soft"))


# --- vocabulary --------------------------------------------------------------------


@query("tag_counts", "SELECT word, tag, count(*) AS freq FROM tagged GROUP BY word, tag")
def _(spark, d):
    return vocab.tag_counts(fx.tagged(spark, d))


@query("vocab_filter", f"SELECT * FROM (SELECT word, tag, count(*) AS freq FROM tagged GROUP BY word, tag) WHERE {o.suitable()}")
def _(spark, d):
    return vocab.vocab_filter(vocab.tag_counts(fx.tagged(spark, d)))


@query("build_vocab", "SELECT key, id, tag, freq FROM vocab")
def _(spark, d):
    return vocab.build_vocab(fx.tagged(spark, d))


@query("proper_nouns", "SELECT key, count(*) OVER () AS n_proper_nouns FROM vocab WHERE tag = 'NNP'")
def _(spark, d):
    container = fx.vocab(spark, d)
    n = vocab.count_proper_nouns(container).scalar()
    return vocab.proper_nouns(container).select("key", n.alias("n_proper_nouns"))


@query(
    "container_lookup",
    """SELECT b.key, b.place, v.id, v.tag, v.freq, v.key IS NOT NULL AS known,
         (SELECT key FROM vocab WHERE id = b.place) AS key_at_place, (SELECT count(*) FROM vocab) AS size
       FROM bench_keys b LEFT JOIN vocab v ON v.key = b.key""",
)
def _(spark, d):
    container = fx.vocab(spark, d)
    found = vocab.lookup_keys(fx.benchmark_words(spark, d), container)
    by_id = vocab.lookup_ids(found.select(F.col("place").alias("id")), container).select(
        F.col("id").alias("place"), F.col("key").alias("key_at_place")
    )
    size = vocab.container_size(container).scalar()
    return found.join(by_id, "place").select(
        "key", "place", "id", "tag", "freq", F.col("id").isNotNull().alias("known"), "key_at_place", size.alias("size")
    )


EN_VOCAB = o.vocab_sql("tagged", "paper_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
REST_VOCAB = o.vocab_sql("tagged", "paper_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')")


@query(
    "container_union",
    f"""SELECT key, row_number() OVER (ORDER BY side, old) - 1 AS id, tag, freq::BIGINT AS freq FROM (
       SELECT key, min(side) AS side, arg_min(id, side) AS old, arg_min(tag, side) AS tag, sum(freq) AS freq FROM (
         SELECT *, 0 AS side FROM ({EN_VOCAB}) UNION ALL SELECT *, 1 FROM ({REST_VOCAB})) GROUP BY key)""",
)
def _(spark, d):
    langs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "lang")
    tagged = fx.tagged(spark, d).join(langs, "paper_id")
    left = vocab.build_vocab(tagged.filter("lang = 'en'").drop("lang"))
    right = vocab.build_vocab(tagged.filter("lang <> 'en'").drop("lang"))
    return vocab.container_union(left, right)


@query(
    "keep_keys",
    "SELECT key, row_number() OVER (ORDER BY place) - 1 AS id, tag, freq FROM bench_keys JOIN vocab USING (key)",
)
def _(spark, d):
    return vocab.keep_keys(fx.vocab(spark, d), fx.benchmark_words(spark, d), "place")


@query(
    "remove_keys",
    "SELECT key, row_number() OVER (ORDER BY id) - 1 AS id, tag, freq FROM vocab WHERE key NOT IN (SELECT key FROM bench_keys)",
)
def _(spark, d):
    return vocab.remove_keys(fx.vocab(spark, d), fx.benchmark_words(spark, d))


@query("sorted_by", "SELECT key, row_number() OVER (ORDER BY freq DESC, id) - 1 AS id, tag, freq FROM vocab")
def _(spark, d):
    return vocab.sorted_by(fx.vocab(spark, d), "freq")


@query("multi_hot", "SELECT t.paper_id, v.id, count(*) AS n FROM tok t JOIN vocab v ON v.key = t.word GROUP BY ALL")
def _(spark, d):
    items = fx.words(spark, d).select("paper_id", F.explode("Abstract").alias("key"))
    return vocab.multi_hot(items, fx.vocab(spark, d))


@query("describe_container", "SELECT id, 'word: ' || key || ', POS tag: ' || tag AS line FROM vocab")
def _(spark, d):
    return vocab.describe(fx.vocab(spark, d))


@query("describe_phrases", "SELECT id, 'Phrase: ' || w1 || ' ' || w2 || ', POS tags: ' || tag1 || ', ' || tag2 AS line FROM phrases")
def _(spark, d):
    return vocab.describe(phrases.build_phrases(fx.words(spark, d), fx.vocab(spark, d)))


# --- phrases -------------------------------------------------------------------------


def stream(spark, d):
    return phrases.phrase_word_stream(fx.words(spark, d), fx.vocab(spark, d))


def scored_pairs(spark, d):
    scored = phrases.mutual_information(phrases.pair_counts(stage(stream(spark, d), "stream")))
    return phrases.with_words(scored, fx.vocab(spark, d))


@query("phrase_word_stream", "SELECT paper_id, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids FROM stream GROUP BY paper_id")
def _(spark, d):
    return stream(spark, d).select("paper_id", joined(F.col("stream").cast("array<string>")).alias("ids"))


@query(
    "context_counts",
    "SELECT v1.key AS w1, v2.key AS w2, p.freq FROM pairs p JOIN vocab v1 ON v1.id = p.id1 JOIN vocab v2 ON v2.id = p.id2",
)
def _(spark, d):
    return phrases.context_counts(phrases.pair_counts(stage(stream(spark, d), "stream")), fx.vocab(spark, d))


@query("mutual_information", "SELECT w1, w2, freq, round(mutual_info, 9) AS mutual_info FROM scored_pairs")
def _(spark, d):
    return scored_pairs(spark, d).select("w1", "w2", "freq", rounded("mutual_info", "mutual_info", 9))


@query("top_phrases", "SELECT w1, w2, id, tag1, tag2, round(mutual_info, 9) AS mutual_info, freq FROM phrases")
def _(spark, d):
    top = phrases.build_phrases(fx.words(spark, d), fx.vocab(spark, d))
    return top.withColumn("mutual_info", F.round("mutual_info", 9))


@query("phrases_to_vocab", "SELECT w1 || '_' || w2 AS key, id, tag1 || ',' || tag2 AS tag, freq FROM phrases")
def _(spark, d):
    return phrases.phrases_to_vocab(phrases.build_phrases(fx.words(spark, d), fx.vocab(spark, d)))


# --- feature scores --------------------------------------------------------------------


def labelled(spark, d):
    """Processed papers repeated per class, class index as ``label``."""
    repeated = labels.explode_labels(fx.corpus(spark, d).papers, fx.bank(spark))
    return labels.describe_codes(repeated, fx.bank(spark)).select(F.col("label_id").alias("label"), "Abstract")


def cells(spark, d):
    return scores.label_word_counts(labelled(spark, d), fx.corpus(spark, d).vocab)


def tfidf(spark, d):
    return stage(scores.tfidf(fx.corpus(spark, d).vocab, labelled(spark, d)), "tfidf")


@query("label_word_counts", "SELECT id, label, n FROM cells")
def _(spark, d):
    return cells(spark, d)


@query("tf_idf_parts", "SELECT key, id, tag, doc_freq, round(idf, 6) AS idf, round(tf_sum, 6) AS tf_sum FROM tfidf_parts")
def _(spark, d):
    n_labels = labelled(spark, d).agg(F.count_distinct("label")).first()[0]
    parts = scores.tf_idf_parts(cells(spark, d), fx.corpus(spark, d).vocab, n_labels)
    return parts.select("key", "id", "tag", "doc_freq", rounded("idf", "idf"), rounded("tf_sum", "tf_sum"))


@query("tfidf", "SELECT key, id, tag, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf FROM tfidf_words")
def _(spark, d):
    container = scores.tfidf(fx.corpus(spark, d).vocab, labelled(spark, d))
    return container.select("key", "id", "tag", rounded("idf", "idf"), rounded("tfidf", "tfidf"))


def bottom_sql(where: str) -> str:
    return f"""SELECT key, count(*) OVER () - 1 - rk AS place, round(round(tfidf, 9), 6) AS tfidf FROM (
      SELECT *, row_number() OVER (ORDER BY round(tfidf, 9), id DESC) - 1 AS rk FROM tfidf_words WHERE {where}) WHERE rk < 200"""


def ranked_words(df):
    return df.select("key", "place", F.round(F.round("tfidf", 9), 6).alias("tfidf"))


@query(
    "top_n_features",
    """SELECT key, rk AS place, round(round(tfidf, 9), 6) AS tfidf FROM (
       SELECT *, row_number() OVER (ORDER BY round(tfidf, 9) DESC, id) - 1 AS rk FROM tfidf_words) WHERE rk < 200""",
)
def _(spark, d):
    return ranked_words(scores.top_n(tfidf(spark, d), 200))


@query("bottom_n_features", bottom_sql("true"))
def _(spark, d):
    return ranked_words(scores.bottom_n(tfidf(spark, d), 200))


@query("bottom_n_nnp", bottom_sql("tag = 'NNP'"))
def _(spark, d):
    return ranked_words(scores.bottom_n_proper_nouns(tfidf(spark, d), 200))


@query("bottom_n_not_nnp", bottom_sql("tag <> 'NNP'"))
def _(spark, d):
    return ranked_words(scores.bottom_n_others(tfidf(spark, d), 200))


REDUCED_SQL = """SELECT v.key, rk AS id, v.tag, v.freq FROM (
  SELECT id, row_number() OVER (ORDER BY round(tfidf, 9) DESC, id) - 1 AS rk FROM tfidf_words) r JOIN full_vocab v USING (id) WHERE rk < 5000"""


@query("reduce_vocab", REDUCED_SQL)
def _(spark, d):
    return scores.reduce_vocab(fx.corpus(spark, d).vocab, tfidf(spark, d), 5000)


def language_texts(spark, d):
    return spread(fx.table(spark, d, "documents").select(F.col("lang").alias("label"), F.col("text").alias("Abstract")))


def language_cells(spark, d):
    split = language_texts(spark, d).withColumn("Abstract", text.whitespace_words(F.col("Abstract")))
    chosen = tokens.selected_tokens(split, fx.vocab(spark, d).select("key", "id"), "label")
    return stage(chosen.groupBy("id", "label").agg(F.count("*").alias("n")), "cells")


def word_probs(spark, d):
    return scores.word_label_probs(language_texts(spark, d), language_cells(spark, d), fx.vocab(spark, d))


@query("label_prior", "SELECT label, n_docs, round(p_label, 9) AS p_label FROM prior")
def _(spark, d):
    return scores.label_prior(language_texts(spark, d)).withColumn("p_label", F.round("p_label", 9))


@query(
    "word_label_probs",
    "SELECT key, id, label, round(p_word, 9) AS p_word, round(p_word_label, 9) AS p_word_label FROM word_probs",
)
def _(spark, d):
    return word_probs(spark, d).select("key", "id", "label", rounded("p_word", "p_word", 9), rounded("p_word_label", "p_word_label", 9))


@query("label_given_word", "SELECT key, id, label, round(p_label_word, 6) AS p_label_word FROM posterior")
def _(spark, d):
    return scores.label_given_word(word_probs(spark, d)).withColumn("p_label_word", F.round("p_label_word", 6))


@query("entropy", "SELECT key, id, round(sum(-p_label_word * log2(p_label_word)), 6) AS entropy FROM posterior GROUP BY key, id")
def _(spark, d):
    posterior = scores.label_given_word(word_probs(spark, d))
    return posterior.groupBy("key", "id").agg(rounded(scores.entropy_bits(F.col("p_label_word")), "entropy"))


@query(
    "information_gain",
    """SELECT key, id, round((SELECT sum(-p_label * log2(p_label)) FROM prior) + sum(p_label_word * log2(p_label_word)), 6) AS gain
       FROM posterior GROUP BY key, id""",
)
def _(spark, d):
    return features.information_gain(language_texts(spark, d), fx.vocab(spark, d)).withColumn("gain", F.round("gain", 6))


@query(
    "information_gain_normalized",
    """SELECT key, id, round((SELECT sum(-p_label * log2(p_label)) FROM prior) + sum(q * log2(q)), 6) AS gain
       FROM (SELECT *, p_label_word / sum(p_label_word) OVER (PARTITION BY id) AS q FROM posterior) GROUP BY key, id""",
)
def _(spark, d):
    gains = features.information_gain(language_texts(spark, d), fx.vocab(spark, d), normalized=True)
    return gains.withColumn("gain", F.round("gain", 6))


# --- labels ----------------------------------------------------------------------------


@query("split_codes", """SELECT paper_id, len(string_split("MSCs", '|')) AS n, string_split("MSCs", '|')[1] AS first, string_split("MSCs", '|')[-1] AS last FROM papers""")
def _(spark, d):
    listed = labels.as_code_list(fx.papers(spark, d))
    return listed.select(
        "paper_id", F.size("MSCs").cast("bigint").alias("n"), F.element_at("MSCs", 1).alias("first"), F.element_at("MSCs", -1).alias("last")
    )


@query("codes_at_depth", CODES_AT_3)
def _(spark, d):
    listed = labels.as_code_list(fx.papers(spark, d))
    return listed.select("paper_id", joined(codes.codes_at_depth(F.col("MSCs"), 3), "|").alias("codes"))


PAPER_CODES = """SELECT p.paper_id, coalesce(c.codes, '') AS codes FROM papers p LEFT JOIN (
  SELECT paper_id, string_agg(code, '|' ORDER BY pos) AS codes FROM codes GROUP BY paper_id) c ON c.paper_id = p.paper_id"""


@query("valid_codes", PAPER_CODES)
def _(spark, d):
    cut = tables.at_depth(fx.papers(spark, d), 2)
    cut = labels.as_code_list(fx.papers(spark, d)).withColumn("MSCs", codes.codes_at_depth(F.col("MSCs"), 2))
    return labels.valid_codes(cut, fx.bank(spark)).select("paper_id", joined("MSCs", "|").alias("codes"))


@query("clean_codes", PAPER_CODES)
def _(spark, d):
    cleaned = CodeCleaner(fx.bank(spark), 2).transform(fx.papers(spark, d))
    return cleaned.select("paper_id", joined("MSCs", "|").alias("codes"))


@query("explode_labels", 'SELECT paper_id, code FROM codes')
def _(spark, d):
    return labels.explode_labels(fx.papers(spark, d), fx.bank(spark)).select("paper_id", F.col("MSCs").alias("code"))


@query(
    "describe_codes",
    """SELECT p.paper_id, p.code, b.id AS label_id, b.description FROM (
       SELECT paper_id, substr(unnest(string_split("MSCs", '|')), 1, 2) AS code FROM papers) p LEFT JOIN bank b ON b.key = p.code""",
)
def _(spark, d):
    listed = labels.as_code_list(fx.papers(spark, d)).select("paper_id", F.explode("MSCs").alias("code"))
    cut = tables.at_depth(listed, 2, "code")
    return labels.describe_codes(cut, fx.bank(spark), "code").select("paper_id", "code", "label_id", "description")


# The five demonstration classes.
SELECTION = ["05", "19", "47", "57", "60"]


@query(
    "select_labels",
    """SELECT c.paper_id, c.first, CASE c.first WHEN '05' THEN 0 WHEN '19' THEN 1 WHEN '47' THEN 2 WHEN '57' THEN 3 ELSE 4 END::BIGINT AS label_id
       FROM (SELECT paper_id, arg_min(code, pos) AS first FROM codes GROUP BY paper_id) c WHERE c.first IN ('05', '19', '47', '57', '60')""",
)
def _(spark, d):
    cleaned = labels.clean_codes(fx.papers(spark, d), fx.bank(spark), 2)
    papers, bank = labels.select_labels(cleaned, fx.bank(spark), SELECTION)
    first = papers.select("paper_id", F.get("MSCs", F.lit(0)).alias("first"))
    return labels.describe_codes(first, bank, "first").select("paper_id", "first", "label_id")


@query(
    "drop_unusable",
    """SELECT c.paper_id, c.code, len(w.w) AS n_words FROM codes c JOIN words w ON w.paper_id = c.paper_id WHERE len(w.w) >= 10""",
)
def _(spark, d):
    papers = labels.drop_unusable(labels.clean_codes(fx.words(spark, d), fx.bank(spark), 2))
    return papers.select("paper_id", F.explode("MSCs").alias("code"), F.size("Abstract").cast("bigint").alias("n_words"))


# --- splits and sequences -----------------------------------------------------------------


def documents(spark, d):
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "lang")


RANKED_DOCS = "(SELECT doc_id AS paper_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS rk, count(*) OVER () AS n FROM documents)"


@query("split_80_20", f"SELECT paper_id, lang, CASE WHEN rk < floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM {RANKED_DOCS}")
def _(spark, d):
    return splits.split_80_20(documents(spark, d))


@query(
    "split_80_10_10",
    f"SELECT paper_id, lang, CASE WHEN rk < n * 80 // 100 THEN 'train' WHEN rk < n * 90 // 100 THEN 'test' ELSE 'validation' END AS split FROM {RANKED_DOCS}",
)
def _(spark, d):
    return splits.split_80_10_10(documents(spark, d))


@query("shuffle_seeded", "SELECT s.paper_id, d.lang, s.position FROM shuffled s JOIN documents d ON d.doc_id = s.paper_id")
def _(spark, d):
    return splits.shuffle_seeded(documents(spark, d))


@query("split_tail", f"SELECT paper_id, lang, CASE WHEN rk < n - least(n * 10 // 100, 1000) THEN 'train' ELSE 'test' END AS split FROM {RANKED_DOCS}")
def _(spark, d):
    return splits.split_tail(documents(spark, d), [F.col("paper_id")], limit=1000)


@query(
    "slice_train",
    f"""SELECT paper_id, lang, split FROM (SELECT *, CASE WHEN rk < floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM {RANKED_DOCS})
        WHERE split = 'test' OR (rk >= 30 AND rk < 120)""",
)
def _(spark, d):
    return splits.slice_train(splits.split_80_20(documents(spark, d)), 30, 120)


@query("mini_batches", f"SELECT paper_id, lang, rk // 64 AS batch FROM {RANKED_DOCS} WHERE rk // 64 < n // 64")
def _(spark, d):
    return splits.mini_batches(documents(spark, d), 64)


PRIMARY = "(SELECT paper_id, arg_min(code, pos) AS code FROM codes GROUP BY paper_id)"


def primary_papers(spark, d):
    return labels.primary_label(labels.clean_codes(fx.papers(spark, d), fx.bank(spark), 2), fx.bank(spark))


@query(
    "primary_label",
    """SELECT paper_id, substr(string_split("MSCs", '|')[1], 1, 2) AS code FROM papers
       WHERE substr(string_split("MSCs", '|')[1], 1, 2) IN (SELECT key FROM bank)""",
)
def _(spark, d):
    # Codes are cut but not validated: the first one decides.
    cut = labels.as_code_list(fx.papers(spark, d)).withColumn("MSCs", codes.codes_at_depth(F.col("MSCs"), 2))
    return labels.primary_label(cut, fx.bank(spark)).select("paper_id", "code")


@query("label_index", f"SELECT p.paper_id, b.id AS y FROM {PRIMARY} p JOIN bank b ON b.key = p.code")
def _(spark, d):
    return labels.label_index(primary_papers(spark, d), fx.bank(spark)).select("paper_id", "y")


@query(
    "multi_label_vector",
    """SELECT p.paper_id, string_agg(CASE WHEN c.code IS NULL THEN '0' ELSE '1' END, ',' ORDER BY b.id) AS y
       FROM papers p CROSS JOIN bank b LEFT JOIN codes c ON c.paper_id = p.paper_id AND c.code = b.key GROUP BY p.paper_id""",
)
def _(spark, d):
    vector = labels.multi_label_vector(labels.clean_codes(fx.papers(spark, d), fx.bank(spark), 2), fx.bank(spark))
    return vector.select("paper_id", numbers("y").alias("y"))


@query("sequence_length", "SELECT paper_id, len(w)::INTEGER AS length FROM words")
def _(spark, d):
    return splits.with_sequence_length(fx.words(spark, d)).select("paper_id", "length")


@query(
    "padded_sequence",
    f"""SELECT w.paper_id, g.step, round(coalesce(s.vector[1], 0)::DOUBLE, 6) AS first, round(coalesce(s.vector[8], 0)::DOUBLE, 6) AS last,
          count(s.paper_id) OVER (PARTITION BY w.paper_id) AS effective_length
        FROM words w CROSS JOIN (SELECT unnest(range(50)) AS step) g
        LEFT JOIN ({SEQUENCE_SQL}) s ON s.paper_id = w.paper_id AND s.step = g.step""",
)
def _(spark, d):
    filled = splits.padded_sequence(fx.words(spark, d).select("paper_id", "Abstract"), fx.word_vectors(spark, d), fx.VECTOR_DIM)
    steps = filled.select("paper_id", F.col("effective_length").cast("bigint").alias("effective_length"), F.posexplode("x").alias("step", "v"))
    return steps.select(
        "paper_id", F.col("step").cast("bigint").alias("step"), rounded(F.element_at("v", 1).cast("double"), "first"),
        rounded(F.element_at("v", -1).cast("double"), "last"), "effective_length",
    )


def cleaned_papers(spark, d):
    return labels.clean_codes(fx.words(spark, d), fx.bank(spark), 2).filter(F.size("MSCs") > 0)


@query(
    "rnn_training_set",
    f"""SELECT s.paper_id, len(w.w)::INTEGER AS length, coalesce(e.n, 0)::INTEGER AS effective_length, s.y, s.split, 50 AS steps
        FROM samples s JOIN words w ON w.paper_id = s.paper_id
        LEFT JOIN (SELECT paper_id, count(*) AS n FROM ({SEQUENCE_SQL}) GROUP BY paper_id) e ON e.paper_id = s.paper_id""",
)
def _(spark, d):
    samples = training.rnn_training_set(cleaned_papers(spark, d), fx.word_vectors(spark, d), fx.bank(spark), fx.VECTOR_DIM)
    return samples.select("paper_id", "length", "effective_length", "y", "split", F.size("x").alias("steps"))


@query(
    "rnn_training_set_all_codes",
    """SELECT s.paper_id, s.split, string_agg(CASE WHEN c.code IS NULL THEN '0' ELSE '1' END, ',' ORDER BY b.id) AS y
       FROM samples s CROSS JOIN bank b LEFT JOIN codes c ON c.paper_id = s.paper_id AND c.code = b.key GROUP BY s.paper_id, s.split""",
)
def _(spark, d):
    samples = training.rnn_training_set(cleaned_papers(spark, d), fx.word_vectors(spark, d), fx.bank(spark), fx.VECTOR_DIM, primary=False)
    return samples.select("paper_id", "split", numbers("y").alias("y"))


@query(
    "t2v_from_papers",
    f"""SELECT p.paper_id, 200 AS dim, round(coalesce(s.total, 0), 4) AS total, coalesce(c.labels, '') AS labels,
          CASE WHEN rk < n * 80 // 100 THEN 'train' WHEN rk < n * 90 // 100 THEN 'test' ELSE 'validation' END AS split
        FROM (SELECT paper_id, row_number() OVER (ORDER BY paper_id) - 1 AS rk, count(*) OVER () AS n FROM papers) p
        LEFT JOIN (SELECT paper_id, sum(list_sum(v.vector::DOUBLE[])) AS total FROM ({o.drawn_sql('vec_selected', 25, 7)}) d
          JOIN word_vectors v ON v.word = d.word GROUP BY paper_id) s ON s.paper_id = p.paper_id
        LEFT JOIN (SELECT paper_id, string_agg(b.id::VARCHAR, ',' ORDER BY b.id) AS labels FROM codes JOIN bank b ON b.key = code GROUP BY paper_id) c ON c.paper_id = p.paper_id""",
)
def _(spark, d):
    papers = labels.clean_codes(fx.raw_texts(spark, d), fx.bank(spark), 2)
    made = training.t2v_from_papers(papers, fx.word_vectors(spark, d), fx.bank(spark), fx.VECTOR_DIM, seed=7)
    classes = F.filter(F.transform("y", lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())
    return made.select(
        "paper_id", F.size("vector").alias("dim"), rounded(arrays.array_sum(F.col("vector").cast("array<double>")), "total", 4), numbers(classes).alias("labels"), "split")


@query(
    "unigram_training_set",
    """SELECT s.paper_id, t.id, t.n, round(1.0 / c.k, 6) AS weight, c.k FROM split_test s
       JOIN (SELECT paper_id, id, count(*) AS n FROM ptok GROUP BY ALL) t USING (paper_id)
       JOIN (SELECT paper_id, count(*) AS k FROM pcodes GROUP BY paper_id) c USING (paper_id)""",
)
def _(spark, d):
    corpus = fx.corpus(spark, d)
    split = training.unigram_training_set(corpus.papers)
    counts, truth = training.unigram_test_matrices(split, corpus.vocab, fx.bank(spark))
    weight = truth.select(
        "paper_id", rounded(F.array_max("y"), "weight"), F.size(F.filter("y", lambda x: x > 0)).cast("bigint").alias("k")
    )
    return counts.join(weight, "paper_id")


@query(
    "t2v_training_set",
    """SELECT vec_id, label, CASE WHEN rk < n * 80 // 100 THEN 'train' WHEN rk < n * 90 // 100 THEN 'test' ELSE 'validation' END AS split,
         round(total, 4) AS total FROM (
       SELECT vec_id, label::BIGINT AS label, list_sum(embedding::DOUBLE[]) AS total, row_number() OVER (ORDER BY vec_id) - 1 AS rk, count(*) OVER () AS n FROM embeddings)""",
)
def _(spark, d):
    emb = fx.table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector"), F.array(F.col("label").cast("string")).alias("MSCs")
    )
    classes = with_dense_id(emb.select(F.explode("MSCs").alias("key")).distinct(), F.col("key").cast("int")).select(
        "key", F.col("id").cast("int").alias("id"), F.lit("").alias("description")
    )
    split = training.t2v_training_set(emb, classes, id_col="vec_id")
    return split.select(
        "vec_id", (F.array_position("y", 1) - 1).alias("label"), "split",
        rounded(arrays.array_sum(F.col("vector").cast("array<double>")), "total", 4),
    )


# --- vectors ---------------------------------------------------------------------------------


@query(
    "train_word2vec",
    """SELECT v.key AS word, 16 AS dim FROM full_vocab v JOIN (SELECT id, count(*) AS n FROM ptok GROUP BY id) t USING (id) WHERE n >= 5""",
)
def _(spark, d):
    # The stored texts hold vocabulary words only; every one met five times gets a vector.
    trained = vectors.train_word2vec(fx.corpus(spark, d).papers, fx.corpus(spark, d).vocab, dim=16)
    return trained.select("word", F.size("vector").alias("dim"))


NEAR_QUERIES, NEAR_SHARE = 400, 0.8


@query(
    "train_skipgram",
    """SELECT v.key AS word, 16 AS dim, true AS related FROM vocab v JOIN (SELECT word, count(*) AS n FROM tok GROUP BY word) t ON t.word = v.key
       WHERE n >= 5""",
)
def _(spark, d):
    """Every word met five times with its vector; the nearest words of the most frequent ones are of their language."""
    corpus, vocab = fx.words(spark, d), fx.vocab(spark, d)
    trained = stage(skipgram.train_skipgram(corpus, vocab, dim=16, window=5), "skipgram")
    return trained.select("word", F.size("vector").alias("dim"), F.lit(language_share(spark, d, corpus, trained) >= NEAR_SHARE).alias("related"))


def language_share(spark, d, corpus, trained) -> float:
    """How many of the most frequent words have a nearest word of the same main language."""
    langs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "lang")
    tokens_of = corpus.join(langs, "paper_id").select("lang", F.explode("Abstract").alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    main = stage(tokens_of.groupBy("word").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.sum("n").alias("n")), "languages")
    asked = trained.join(main, "word").orderBy(F.desc("n"), "word").limit(NEAR_QUERIES)
    near = skipgram.nearest_words(trained, asked)
    both = near.join(main.select(F.col("word").alias("query"), F.col("lang").alias("own")), "query").join(main.select("word", "lang"), "word")
    return both.agg(F.avg((F.col("lang") == F.col("own")).cast("double"))).first()[0] or 0.0


SVD_DIM = 4


@query(
    "train_svd_vectors",
    f"""SELECT v.key AS word, {SVD_DIM} AS dim, true AS orthonormal, true AS dominant FROM vocab v""",
)
def _(spark, d):
    """Every word of the vocabulary with its vector; orthonormal columns, and a residual that says they span the first singular vectors."""
    corpus, vocab = fx.words(spark, d), fx.vocab(spark, d)
    trained = stage(vectors.train_svd_vectors(corpus, vocab, SVD_DIM), "svd")
    parts = [F.sum(F.get("vector", F.lit(i)).cast("double") * F.get("vector", F.lit(j))).alias(f"g{i}{j}") for i in range(SVD_DIM) for j in range(SVD_DIM)]
    gram = trained.agg(*parts).first()
    orthonormal = all(abs(gram[f"g{i}{j}"] - (i == j)) < 1e-4 for i in range(SVD_DIM) for j in range(SVD_DIM))
    return trained.select("word", F.size("vector").alias("dim"), F.lit(orthonormal).alias("orthonormal"), F.lit(svd_residual(corpus, vocab, trained) < 1e-2).alias("dominant"))


def svd_residual(corpus, vocab, trained) -> float:
    """How far counts x counts' leaves the span of the vectors: |A A' u - s s u| / s s, the largest of all columns."""
    numbered = stage(with_dense_id(vocab.select("key").distinct(), "key"), "numbered")
    selected = tokens.select_in_vocab(corpus.select("paper_id", "Abstract"), vocab)
    cells = subspace.cells_of(stage(known_ids(selected, numbered, "Abstract"), "texts"), "paper_id", "Abstract")
    tiles = stage(subspace.packed(cells.withColumn("none", F.array_repeat(F.lit(0.0), SVD_DIM)), "Abstract", "none"), "cells")
    own = trained.join(numbered, F.col("word") == F.col("key")).select("id", "vector")
    u = stage(subspace.block_of(own, SVD_DIM), "vectors")
    z = stage(subspace.multiplied(tiles, subspace.Sent(u, SVD_DIM, np.eye(SVD_DIM)), SVD_DIM), "back")
    s, zz = (np.diag(subspace.inner_products(z, other, SVD_DIM)) for other in (u, z))
    # |z - s u|^2 = z z - s^2 for a unit vector u.
    s, zz = s[s != 0], zz[s != 0]
    return float((np.sqrt(np.maximum(zz - s * s, 0.0)) / s).max(initial=0.0))


@query(
    "vector_lookup",
    """SELECT b.key AS word, v.word IS NOT NULL AS known, round(v.vector[2]::DOUBLE, 6) AS second,
         (SELECT count(*) FROM word_vectors) AS size FROM bench_keys b LEFT JOIN word_vectors v ON v.word = b.key""",
)
def _(spark, d):
    known = fx.word_vectors(spark, d)
    size = known.agg(F.count("*")).scalar()
    found = vectors.vector_lookup(fx.benchmark_words(spark, d).select(F.col("key").alias("word")), known)
    return found.select(
        "word", F.col("vector").isNotNull().alias("known"), rounded(F.get("vector", F.lit(1)).cast("double"), "second"), size.alias("size")
    )


@query(
    "doc_vector_concat",
    f"""SELECT p.paper_id, 200 AS dim, round(coalesce(s.total, 0), 4) AS total FROM papers p LEFT JOIN (
        SELECT paper_id, sum(list_sum(v.vector::DOUBLE[])) AS total FROM ({o.drawn_sql('vec_selected', 25, 7)}) d
        JOIN word_vectors v ON v.word = d.word GROUP BY paper_id) s ON s.paper_id = p.paper_id""",
)
def _(spark, d):
    texts = fx.raw_texts(spark, d).select("paper_id", "Abstract")
    made = vectors.doc_vector_concat(texts, fx.word_vectors(spark, d), fx.VECTOR_DIM, seed=7)
    return made.select("paper_id", F.size("vector").alias("dim"), rounded(arrays.array_sum(F.col("vector").cast("array<double>")), "total", 4))


@query("doc_vector_counts", "SELECT paper_id, id, count(*) AS n FROM raw_selected GROUP BY paper_id, id")
def _(spark, d):
    return vectors.doc_vector_counts(fx.raw_texts(spark, d).select("paper_id", "Abstract"), fx.vocab(spark, d))


# --- classifiers ------------------------------------------------------------------------------


@query("train_unigram", TOPICS_SQL)
def _(spark, d):
    return topics(trained_unigram(spark, d))


def class_rows(scored):
    return scored.select("paper_id", F.posexplode("p").alias("label_id", "p")).withColumn("p", F.round("p", 6))


def unigram_scores(spark, d, mode):
    corpus = fx.corpus(spark, d)
    return models.class_scores(corpus.papers, trained_unigram(spark, d), corpus.vocab, mode)


@query("predict_unigram", "SELECT paper_id, label_id, round(p, 6) AS p FROM uni_scores")
def _(spark, d):
    return class_rows(unigram_scores(spark, d, "linear"))


@query("predict_unigram_log", "SELECT paper_id, label_id, round(p, 6) AS p FROM uni_scores_log")
def _(spark, d):
    return class_rows(unigram_scores(spark, d, "log"))


def trained_mlp(spark, d):
    emb = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("y"))
    return emb, models.train_mlp(emb.filter("vec_id % 5 <> 0"), [16], 64, 10, max_iter=30)


@query("train_mlp", "SELECT count(*) AS held_out, true AS better FROM embeddings WHERE vec_id % 5 = 0")
def _(spark, d):
    """Held-out rows, and whether the network names their class more often than the most frequent class would."""
    emb, model = trained_mlp(spark, d)
    held_out = emb.filter("vec_id % 5 = 0")
    majority = emb.filter("vec_id % 5 <> 0").groupBy("y").count().orderBy(F.desc("count"), "y").first()["y"]
    scored = models.predict_mlp(held_out, model).withColumn("label", F.col("y").cast("int"))
    accuracy = metrics.top_k_accuracy(scored, 1).first()["accuracy"]
    return held_out.agg(F.count("*").alias("held_out"), F.avg((F.col("y") == majority).cast("double")).alias("base")).select(
        "held_out", (F.lit(accuracy) > F.col("base")).alias("better"))


@query("predict_mlp", "SELECT vec_id, 10 AS classes, 1.0 AS total, true AS best_is_predicted FROM embeddings")
def _(spark, d):
    """Class probabilities, and whether the largest belongs to the class that the model itself predicts."""
    emb, model = trained_mlp(spark, d)
    own = model.transform(emb.select("vec_id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))).select("vec_id", "prediction")
    scored = models.predict_mlp(emb, model).join(own, "vec_id")
    return scored.select(
        "vec_id", F.size("p").alias("classes"), rounded(arrays.array_sum(F.col("p")), "total", 4),
        (F.get("p", F.col("prediction").cast("int")) == F.array_max("p")).alias("best_is_predicted"))


def filled_sequences(spark, d):
    base = fx.words(spark, d).select("paper_id", "Abstract")
    return splits.padded_sequence(base, fx.word_vectors(spark, d), fx.VECTOR_DIM)


@query(
    "score_sequences",
    f"""SELECT w.paper_id, c.c AS label_id, round(coalesce(l.z, 0), 6) AS logit FROM words w CROSS JOIN (SELECT unnest(range(61)) AS c) c
        LEFT JOIN ({logits_sql(SEQUENCE_SQL, 'paper_id')}) l ON l.paper_id = w.paper_id AND l.c = c.c""",
)
def _(spark, d):
    scored = models.score_sequences(filled_sequences(spark, d), fx.linear_model, splits.N_STEPS, fx.VECTOR_DIM)
    rows = scored.select("paper_id", F.posexplode("logits").alias("label_id", "logit"))
    return rows.select("paper_id", F.col("label_id").cast("bigint").alias("label_id"), rounded("logit", "logit"))


@query(
    "prefix_predictions",
    f"""SELECT * FROM (WITH known AS (SELECT t.paper_id, t.word, v.vector, row_number() OVER (PARTITION BY t.paper_id ORDER BY t.pos) AS n_words
          FROM tok t JOIN word_vectors v ON v.word = t.word WHERE t.pos < 15),
        best AS (SELECT paper_id, n_words, arg_min(c, rk) AS c FROM (
            SELECT *, row_number() OVER (PARTITION BY paper_id, n_words ORDER BY round(z, 9) DESC, c) AS rk FROM (
              {logits_sql('SELECT k.paper_id, n.n_words, k.vector FROM known k JOIN known n ON n.paper_id = k.paper_id AND k.n_words <= n.n_words', 'paper_id, n_words')}
            )) GROUP BY paper_id, n_words)
        SELECT k.paper_id, k.n_words::INTEGER AS n_words, k.word, b.key, b.description
        FROM known k JOIN best USING (paper_id, n_words) JOIN bank b ON b.id = best.c)""",
)
def _(spark, d):
    return models.prefix_predictions(
        fx.words(spark, d).select("paper_id", "Abstract"), fx.word_vectors(spark, d), fx.bank(spark), fx.linear_model, fx.VECTOR_DIM
    )


# --- thresholds and metrics ----------------------------------------------------------------------


def grid_sql(n: int, beta: float = 1.0) -> str:
    """Counts and F-beta per class and grid point by direct evaluation of every threshold."""
    return f"""SELECT c, k, k / {n - 1} AS threshold, round({o.fbeta(beta)}, 12) AS f FROM (
      SELECT c, k, count(*) FILTER (y = 1 AND hit) AS tp, count(*) FILTER (y = 0 AND hit) AS fp, count(*) FILTER (y = 1 AND NOT hit) AS fn
      FROM (SELECT s.c, s.y, g.k, (s.p > g.k / {n - 1} OR (max(s.p) OVER (PARTITION BY s.vec_id, g.k) <= g.k / {n - 1} AND s.place = 1)) AS hit
            FROM score_best s CROSS JOIN (SELECT unnest(range({n})) AS k) g) GROUP BY c, k)"""


def first_best_sql(n: int, beta: float) -> str:
    return f"""SELECT c::INTEGER AS class_id, round(threshold, 9) AS threshold, round(f, 9) AS f_beta, c::VARCHAR AS label FROM (
      SELECT *, row_number() OVER (PARTITION BY c ORDER BY f DESC, k) AS r FROM ({grid_sql(n, beta)})) WHERE r = 1"""


def threshold_rows(df):
    return df.select("class_id", rounded("threshold", "threshold", 9), rounded("f_beta", "f_beta", 9), "label")


@query("fit_thresholds", first_best_sql(50, 1.0))
def _(spark, d):
    return threshold_rows(thresholds.fit_thresholds(fx.scores(spark, d)))


@query("fit_thresholds_beta2", first_best_sql(50, 2.0))
def _(spark, d):
    return threshold_rows(thresholds.fit_thresholds(fx.scores(spark, d), beta=2.0))


@query(
    "predict_thresholds",
    f"""SELECT vec_id, string_agg(CASE WHEN s.p > t.threshold THEN '1' ELSE '0' END, ',' ORDER BY s.c) AS y_hat
        FROM score_cells s JOIN (SELECT c, threshold, row_number() OVER (PARTITION BY c ORDER BY f DESC, k) AS r FROM ({grid_sql(50)})) t
        ON t.c = s.c AND t.r = 1 GROUP BY vec_id""",
)
def _(spark, d):
    fitted = thresholds.threshold_values(thresholds.fit_thresholds(fx.scores(spark, d)))
    predicted = thresholds.predict_thresholds(fx.scores(spark, d), fitted, fill=False)
    return predicted.select("vec_id", numbers("y_hat").alias("y_hat"))


FILLED = """SELECT vec_id, c, y, p, place, CASE WHEN p > 0.2 OR (place = 1 AND max(p) OVER (PARTITION BY vec_id) <= 0.2) THEN 1 ELSE 0 END AS h FROM score_best"""


@query("fill_gaps", f"SELECT vec_id, string_agg(h::VARCHAR, ',' ORDER BY c) AS y_hat FROM ({FILLED}) GROUP BY vec_id")
def _(spark, d):
    predicted = thresholds.predict_thresholds(fx.scores(spark, d))
    return predicted.select("vec_id", numbers("y_hat").alias("y_hat"))


@query(
    "fbeta_by_class",
    f"""SELECT class_id, tp, fp, fn, round({o.fbeta(1.0)}, 6) AS f_beta FROM (
        SELECT c::INTEGER AS class_id, count(*) FILTER (y = 1 AND h = 1) AS tp, count(*) FILTER (y = 0 AND h = 1) AS fp,
          count(*) FILTER (y = 1 AND h = 0) AS fn FROM ({FILLED}) GROUP BY c)""",
)
def _(spark, d):
    by_class = metrics.fbeta_by_class(thresholds.predict_thresholds(fx.scores(spark, d)))
    return by_class.withColumn("f_beta", F.round("f_beta", 6))


CURVE = f"SELECT k, threshold, round(avg(f), 9) AS f1 FROM ({grid_sql(30)}) GROUP BY k, threshold"


@query("fit_single_threshold", f"SELECT round(threshold, 9) AS threshold, f1 FROM ({CURVE}) ORDER BY f1 DESC, k LIMIT 1")
def _(spark, d):
    best = thresholds.fit_single_threshold(fx.scores(spark, d))
    return best.select(rounded("threshold", "threshold", 9), rounded("f1", "f1", 9))


@query("threshold_curve", f"SELECT k::INTEGER AS k, round(threshold, 9) AS threshold, f1 FROM ({CURVE})")
def _(spark, d):
    return thresholds.threshold_curve(fx.scores(spark, d)).select("k", rounded("threshold", "threshold", 9), rounded("f1", "f1", 9))


@query(
    "top_k_accuracy",
    """SELECT round(avg(CASE WHEN better < 3 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM (
       SELECT t.vec_id, (SELECT count(*) FROM score_cells s WHERE s.vec_id = t.vec_id AND s.p > t.p) AS better FROM score_cells t WHERE t.c = t.label)""",
)
def _(spark, d):
    return metrics.top_k_accuracy(fx.scores(spark, d)).select(rounded("accuracy", "accuracy", 9))


@query(
    "top_k_label_mass",
    "SELECT round(avg(mass), 9) AS label_mass FROM (SELECT vec_id, sum(y)::DOUBLE AS mass FROM score_best WHERE place <= 3 GROUP BY vec_id)",
)
def _(spark, d):
    return metrics.top_k_label_mass(fx.scores(spark, d)).select(rounded("label_mass", "label_mass", 9))


@query(
    "cross_entropy",
    "SELECT round(avg(lse - own), 9) AS cross_entropy FROM (SELECT vec_id, ln(sum(exp(p))) AS lse, sum(p) FILTER (c = label) AS own FROM score_cells GROUP BY vec_id)",
)
def _(spark, d):
    return metrics.cross_entropy(fx.scores(spark, d)).select(rounded("cross_entropy", "cross_entropy", 9))


@query("quadratic_cost", "SELECT round(avg(e) / 2, 6) AS cost FROM (SELECT c, sum((p - y) * (p - y)) AS e FROM score_cells GROUP BY c)")
def _(spark, d):
    return metrics.quadratic_cost(fx.scores(spark, d)).select(rounded("cost", "cost"))


@query(
    "l2_penalty",
    "SELECT round(sum(w * w) * 0.3 / (2 * 64), 6) AS penalty FROM (SELECT unnest(embedding)::DOUBLE AS w FROM embeddings)",
)
def _(spark, d):
    weights = fx.table(spark, d, "embeddings").select(F.explode("embedding").alias("w")).select(F.col("w").cast("double"))
    return metrics.l2_penalty(weights, 0.3, 64).select(rounded("penalty", "penalty"))


# --- whole jobs -----------------------------------------------------------------------------------


@query("build_phrase_vocab", "SELECT key, id, tag, freq FROM full_vocab")
def _(spark, d):
    return build_phrase_vocab(fx.words(spark, d), fx.TAGGER)


PROCESSED_SQL = """SELECT p.paper_id, c.codes, s.words FROM processed p
  JOIN (SELECT paper_id, string_agg(code, '|' ORDER BY pos) AS codes FROM codes GROUP BY paper_id) c USING (paper_id)
  JOIN (SELECT paper_id, string_agg(key, ' ' ORDER BY p) AS words FROM full_selected GROUP BY paper_id) s USING (paper_id)"""


def flagship(spark, d):
    papers = process_corpus(fx.raw_texts(spark, d), fx.bank(spark), fx.TAGGER, fx.DEPTH).papers
    return papers.select("paper_id", joined("MSCs", "|").alias("codes"), joined("Abstract").alias("words"))


query("process_corpus", PROCESSED_SQL)(flagship)


@query("save_load_pipeline", PROCESSED_SQL)
def _(spark, d):
    """The corpus job as a pipeline of stages: stored before fitting, fitted, stored, loaded and applied."""
    unfitted, fitted = scratch_path(spark, "pipeline"), scratch_path(spark, "pipeline-model")
    Pipeline(stages=[CodeCleaner(fx.bank(spark), fx.DEPTH), AbstractCleaner(), VocabSelector(tag_rule=fx.TAG_SQL), UsableFilter()]).save(unfitted)
    raw = fx.raw_texts(spark, d)
    Pipeline.load(unfitted).fit(raw).save(fitted)
    papers = PipelineModel.load(fitted).transform(raw)
    return papers.select("paper_id", joined("MSCs", "|").alias("codes"), joined("Abstract").alias("words"))


@query("tfidf_feature_selection", REDUCED_SQL)
def _(spark, d):
    corpus = fx.corpus(spark, d)
    _, reduced = features.tfidf_feature_selection(corpus.papers, corpus.vocab, fx.bank(spark), fx.DEPTH, 5000)
    return reduced


@query(
    "unigram_experiment",
    """SELECT paper_id, label_id AS best, round(p, 6) AS p FROM (
       SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY p DESC, label_id) AS r FROM uni_scores_test) WHERE r = 1""",
)
def _(spark, d):
    corpus = fx.corpus(spark, d)
    scored = experiments.unigram_experiment(corpus.papers, corpus.vocab, fx.bank(spark), fx.DEPTH)
    return scored.select("paper_id", "best", rounded(F.array_max("p"), "p"))


@query(
    "sequence_experiment",
    f"""SELECT split, round(avg(CASE WHEN better < 3 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM (
        SELECT s.paper_id, s.split, count(*) FILTER (l.z > own.z) AS better FROM samples s
        LEFT JOIN ({logits_sql(SEQUENCE_SQL, 'paper_id')}) own ON own.paper_id = s.paper_id AND own.c = s.y
        LEFT JOIN ({logits_sql(SEQUENCE_SQL, 'paper_id')}) l ON l.paper_id = s.paper_id
        GROUP BY s.paper_id, s.split) GROUP BY split""",
)
def _(spark, d):
    quality = experiments.sequence_experiment(
        cleaned_papers(spark, d), fx.word_vectors(spark, d), fx.bank(spark), fx.linear_model, fx.VECTOR_DIM
    )
    return quality.withColumn("accuracy", F.round("accuracy", 9))


# --- streams --------------------------------------------------------------------------------------


def landed_pages(spark, d) -> str:
    """Papers as ten files in shuffled order: neighbouring pages overlap by a tenth, dates span some years, old pages land late."""
    path = scratch_path(spark, "landed")
    papers = fx.papers(spark, d).withColumn("ts", F.expr("timestamp'2010-01-01 00:00:00' + make_interval(0, 0, 0, cast((paper_id * 37) % 5000 AS int), 0, 0, 0)"))
    total = papers.count()
    size = max(1, (total + 9) // 10)
    page = F.floor(F.col("paper_id") / size)
    again = F.when((F.col("paper_id") % size < size // 10) & (page > 0), F.array(page, page - 1)).otherwise(F.array(page))
    pages = papers.withColumn("page", F.explode(again)).withColumn("page", F.pmod(F.col("page") * 7 + 3, F.lit(10)))
    pages.repartitionByRange(10, "page").drop("page").write.parquet(path)
    return path


def paper_stream(spark, d):
    path = landed_pages(spark, d)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 3).parquet(path)


@query("stream_ingest", 'SELECT paper_id, "Abstract", "MSCs" FROM papers')
def _(spark, d):
    out = scratch_path(spark, "ingested")
    jobs.stream_ingest(paper_stream(spark, d), out, scratch_path(spark, "ingest-state")).awaitTermination()
    return spark.read.parquet(out).select("paper_id", "Abstract", "MSCs")


LABELS_SQL = """SELECT w.paper_id, string_agg(b.key, '|' ORDER BY b.id) AS labels FROM words w
  LEFT JOIN (SELECT paper_id, label_id, p, row_number() OVER (PARTITION BY paper_id ORDER BY p DESC, label_id) AS r FROM all_scores) s
    ON s.paper_id = w.paper_id AND (s.p > 0.02 OR s.r = 1) AND s.p IS NOT NULL
  LEFT JOIN bank b ON b.id = s.label_id GROUP BY w.paper_id"""
o.TABLES["all_scores"] = o.class_scores_sql("uni_cells", "papers", "full_selected", "linear")
o.refresh()


@query("stream_label", LABELS_SQL)
def _(spark, d):
    corpus, bank = fx.corpus(spark, d), fx.bank(spark)
    scorer = models.prepare_scorer(trained_unigram(spark, d), corpus.vocab)
    out = scratch_path(spark, "labelled")
    jobs.stream_label(
        paper_stream(spark, d), scorer, corpus.vocab, out, scratch_path(spark, "label-state"), thresholds=0.02
    ).awaitTermination()
    # Overlapping pages label a paper twice, with the same result.
    labelled = spark.read.parquet(out).select("paper_id", "y_hat").dropDuplicates(["paper_id"])
    keys = F.lit(labels.bank_keys(bank))
    chosen = F.filter(keys, lambda key, i: F.get("y_hat", i) == 1)
    return labelled.select("paper_id", F.when(F.size(chosen) > 0, joined(chosen, "|")).alias("labels"))
