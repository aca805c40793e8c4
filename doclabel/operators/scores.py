"""Feature scores per word: TF-IDF over labels and information gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclabel.operators.lookup import lookup_join
from doclabel.operators.ordering import with_dense_id
from doclabel.operators.selection import first_rows, numbers_first, selectable
from doclabel.operators.vocab import PROPER_NOUN
from doclabel.staging import stage

# Decimals that decide ties.
TIE_DECIMALS = 9


def label_word_counts(
    docs: DataFrame, vocab: DataFrame, label: str = "label", words: str = "Abstract"
) -> DataFrame:
    """Occurrences of vocabulary words per label: ``(id, label, n)``, observed cells only.

    Words are counted per label before they meet the vocabulary, so a word
    reaches the join at most once per label however frequent it is.
    """
    counts = docs.select(label, F.explode(words).alias("key")).groupBy("key", label).agg(F.count("*").alias("n"))
    return counts.join(vocab.select("key", "id"), "key").select("id", label, "n")


def tf_idf_parts(cells: DataFrame, vocab: DataFrame, n_labels: int, label: str = "label") -> DataFrame:
    """Per word: document frequency, idf and the sum of term frequencies over labels.

    A seen label gives every word 0.5 + 0.5 n / max n; the constant halves cancel
    in the score, so ``tf_sum`` holds the sum of n / max n only.
    """
    cells = stage(cells, "label-words")
    peaks = cells.groupBy(label).agg(F.max("n").alias("peak"))
    per_word = lookup_join(cells, peaks, label).groupBy("id").agg(
        F.count("*").alias("doc_freq"), F.sum(F.col("n") / F.col("peak")).alias("tf_sum")
    )
    parts = vocab.join(per_word, "id", "left")
    doc_freq = F.coalesce("doc_freq", F.lit(0))
    return parts.select(
        "key", "id", "tag", doc_freq.alias("doc_freq"),
        F.when(doc_freq > 0, F.log(1 + F.lit(n_labels) / doc_freq)).otherwise(F.lit(0.0)).alias("idf"),
        F.coalesce("tf_sum", F.lit(0.0)).alias("tf_sum"),
    )


def tfidf_from_parts(parts: DataFrame) -> DataFrame:
    lowest = parts.agg(F.min("tf_sum")).scalar()
    score = F.lit(0.5) * (F.col("tf_sum") - lowest) * F.col("idf")
    return parts.select("key", "id", "tag", "idf", score.alias("tfidf"))


def tfidf(vocab: DataFrame, docs: DataFrame, label: str = "label", words: str = "Abstract") -> DataFrame:
    """TF-IDF container ``(key, id, tag, idf, tfidf)`` of single-label documents."""
    n_labels = docs.agg(F.count_distinct(label)).first()[0]
    cells = label_word_counts(docs, vocab, label, words)
    parts = stage(tf_idf_parts(cells, vocab, n_labels, label), "tfidf-parts")
    return tfidf_from_parts(parts)


def _order(container: DataFrame, attribute: str, descending: bool) -> list[Column]:
    """Keys whose ascending order ranks the rows by the attribute, then by id, both the same way up or down.

    Scores are compared after rounding: sums of floats depend on their order.
    """
    fractional = container.schema[attribute].dataType.typeName() in ("double", "float")
    by = F.round(attribute, TIE_DECIMALS) if fractional else F.col(attribute)
    return [*numbers_first(by, descending, fractional), F.col("id") if descending else -F.col("id")]


def _best(container: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of the order: their border is found by counting, and only they go on."""
    return first_rows(container, order, n) if selectable(container, order) else container


def top_n(container: DataFrame, n: int, attribute: str = "tfidf") -> DataFrame:
    """The ``n`` highest rows, ``place`` 0 first; ties: lower id first."""
    order = _order(container, attribute, descending=True)
    ranked = _ranked(_best(container, n, order), order, "place")
    return ranked.filter(F.col("place") < n).select(*container.columns, "place")


def bottom_n(container: DataFrame, n: int, attribute: str = "tfidf") -> DataFrame:
    """The ``n`` lowest rows, listed from high to low."""
    order = _order(container, attribute, descending=False)
    ranked = _ranked(_best(container, n, order), order, "_rank").filter(F.col("_rank") < n)
    last = ranked.agg(F.max("_rank")).scalar()
    return ranked.withColumn("place", last - F.col("_rank")).select(*container.columns, "place")


def _ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    keys = [f"_by{i}" for i in range(len(order))]
    return with_dense_id(rows.select("*", *[c.alias(k) for c, k in zip(order, keys)]), *keys, name=name)


def bottom_n_proper_nouns(container: DataFrame, n: int, attribute: str = "tfidf") -> DataFrame:
    return bottom_n(container.filter(F.col("tag") == PROPER_NOUN), n, attribute)


def bottom_n_others(container: DataFrame, n: int, attribute: str = "tfidf") -> DataFrame:
    return bottom_n(container.filter(F.col("tag") != PROPER_NOUN), n, attribute)


def reduce_vocab(vocab: DataFrame, scores: DataFrame, n: int | None = None) -> DataFrame:
    """Keep the ``n`` best words (default all) as a new vocabulary, best first."""
    order = _order(scores, "tfidf", descending=True)
    best = scores if n is None else _best(scores, n, order)
    keys = [f"_by{i}" for i in range(len(order))]
    listed = best.select("key", *[c.alias(k) for c, k in zip(order, keys)])
    return with_dense_id(vocab.drop("id").join(listed, "key"), *keys).select(*vocab.columns)


# --- information gain ---------------------------------------------------------


def entropy_bits(p: Column) -> Column:
    """Entropy in bits of the probabilities in a group (an aggregate)."""
    return F.sum(-p * F.log2(p))


def label_prior(docs: DataFrame, label: str = "label") -> DataFrame:
    """P(label), smoothed by one: ``(label, n_docs, p_label)``."""
    counts = docs.groupBy(label).agg(F.count("*").alias("n_docs"))
    totals = counts.agg(F.struct(F.sum("n_docs").alias("docs"), F.count("*").alias("labels"))).scalar()
    p = (F.col("n_docs") + 1) / (totals["docs"] + totals["labels"])
    return counts.select(label, "n_docs", p.alias("p_label"))


def _label_table(docs: DataFrame, cells: DataFrame, vocab_size: int, label: str) -> DataFrame:
    """Per label: prior, words seen (n_l) and the value of a word never seen in it."""
    seen = cells.groupBy(label).agg(F.sum("n").alias("n_words"))
    table = label_prior(docs, label).join(seen, label, "left")
    n_words = F.coalesce("n_words", F.lit(0))
    return table.select(
        label, "p_label", n_words.alias("n_words"),
        (F.lit(1.0) / (n_words + vocab_size)).alias("p_unseen"),
        (F.col("p_label") / (n_words + vocab_size)).alias("unseen"),
    )


def word_label_probs(docs: DataFrame, cells: DataFrame, vocab: DataFrame, label: str = "label") -> DataFrame:
    """Smoothed P(word) and P(word | label) for every word and label.

    The full matrix is the result; each word carries the label table (one row
    per class) and unfolds it, then observed counts are joined in.
    """
    size = vocab.count()
    labels = stage(_label_table(docs, cells, size, label), "labels")
    totals = labels.agg(F.struct(F.sum("n_words").alias("words"), F.count("*").alias("k"))).scalar()
    folded = labels.agg(F.collect_list(F.struct(label, "p_label", "n_words"))).scalar()
    grid = vocab.select("key", "id", F.explode(folded).alias("l")).select("key", "id", "l.*")
    per_word = cells.groupBy("id").agg(F.sum("n").alias("n_word"))
    full = grid.join(cells, ["id", label], "left").join(per_word, "id", "left")
    n = F.coalesce("n", F.lit(0))
    return full.select(
        "key", "id", label, "p_label",
        ((F.coalesce("n_word", F.lit(0)) + totals["k"]) / (totals["words"] + size * totals["k"])).alias("p_word"),
        ((n + 1) / (F.col("n_words") + size)).alias("p_word_label"),
    )


def label_given_word(probs: DataFrame, normalized: bool = False) -> DataFrame:
    """P(label | word) by Bayes' rule; rows sum to 1 only with ``normalized``."""
    value = F.col("p_word_label") * F.col("p_label") / F.col("p_word")
    result = probs.withColumn("p_label_word", value)
    if normalized:
        sums = result.groupBy("id").agg(F.sum("p_label_word").alias("_sum"))
        result = result.join(sums, "id").withColumn("p_label_word", F.col("p_label_word") / F.col("_sum"))
    label = [c for c in probs.columns if c not in ("key", "id", "p_label", "p_word", "p_word_label")]
    return result.select("key", "id", *label, "p_label_word")


def information_gain(
    docs: DataFrame, cells: DataFrame, vocab: DataFrame, label: str = "label", normalized: bool = False
) -> DataFrame:
    """H(label) - H(label | word) of every vocabulary word: ``(key, id, gain)``.

    ``cells`` are the label-word counts of ``docs``. Words never seen with a label
    share one value per label, so the sums over unseen cells are taken once for
    the corpus and corrected by the observed cells of each word.
    """
    size = vocab.count()
    cells = stage(cells, "label-words")
    labels = stage(_label_table(docs, cells, size, label), "labels")
    x = F.col("unseen")
    base = labels.agg(
        F.struct(
            entropy_bits(F.col("p_label")).alias("entropy"),
            F.sum(x).alias("mass"),
            F.sum(x * F.log2(x)).alias("plogp"),
            F.sum("n_words").alias("words"),
            F.count("*").alias("k"),
        )
    ).scalar()
    seen = (F.col("n") + 1) * F.col("unseen")
    corrections = (
        lookup_join(cells, labels.select(label, "unseen"), label)
        .groupBy("id")
        .agg(
            F.sum("n").alias("n_word"),
            F.sum(seen - x).alias("mass"),
            F.sum(seen * F.log2(seen) - x * F.log2(x)).alias("plogp"),
        )
    )
    zero = F.lit(0.0)
    words = vocab.select("key", "id").join(corrections, "id", "left").select(
        "key", "id",
        ((F.coalesce("n_word", F.lit(0)) + base["k"]) / (base["words"] + size * base["k"])).alias("p_word"),
        (base["mass"] + F.coalesce("mass", zero)).alias("mass"),
        (base["plogp"] + F.coalesce("plogp", zero)).alias("plogp"),
    )
    scale = F.col("mass") if normalized else F.col("p_word")
    # sum over labels of (u / s) log2 (u / s) for row values u and scale s
    row_plogp = (F.col("plogp") - F.log2(scale) * F.col("mass")) / scale
    return words.select("key", "id", (base["entropy"] + row_plogp).alias("gain"))
