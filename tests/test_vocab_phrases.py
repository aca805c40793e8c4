import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doclabel.functions import text
from doclabel.operators import lookup, phrases, tokens, vocab
from doclabel.operators.ordering import with_dense_id
from doclabel.plans.corpus import build_phrase_vocab, tag_by


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def container(spark, items):
    return spark.createDataFrame([(k, i, t, f) for i, (k, t, f) in enumerate(items)], "key string, id bigint, tag string, freq bigint")


def test_dense_ids_do_not_depend_on_partitioning(spark):
    values = [(random.Random(1).random() * i, i) for i in range(500)]
    want = {v: n for n, v in enumerate(sorted(values))}
    for parts in (1, 3, 17):
        df = spark.createDataFrame(values, "a double, b bigint").repartition(parts)
        got = {(r["a"], r["b"]): r["id"] for r in with_dense_id(df, "a", "b").collect()}
        assert got == want


@pytest.mark.parametrize("first_id", [0, -5, 2**61])
def test_vocab_keeps_first_place_and_latest_tag(spark, first_id):
    # 'alpha' is seen as JJ first and as NN later; NN wins, the place is that of JJ.
    data = [(first_id, 0, "alpha", "JJ"), (first_id, 1, "Bob", "NNP"), (first_id, 2, "the", "DT"), (first_id + 1, 0, "alpha", "NN"),
            (first_id + 1, 1, "Bob", "NNP"), (first_id + 1, 2, "alpha", "JJ"), (first_id + 1, 3, "alpha", "NN"), (first_id + 1, 4, "rare", "NN")]
    tagged = spark.createDataFrame(data, "paper_id bigint, pos int, word string, tag string")
    got = rows(vocab.build_vocab(tagged, min_freq=2), "id", "key", "tag", "freq")
    assert got == [(0, "alpha", "NN", 2), (1, "Bob", "NNP", 2)]


def test_wide_id_range_uses_decimals(spark):
    data = [(-(2**62), 0, "word", "NN"), (2**62, 0, "else", "NN")]
    tagged = spark.createDataFrame(data, "paper_id bigint, pos int, word string, tag string")
    assert rows(vocab.build_vocab(tagged, min_freq=1), "id", "key") == [(0, "word"), (1, "else")]


def test_container_algebra(spark):
    left = container(spark, [("a", "NN", 5), ("b", "JJ", 2)])
    right = container(spark, [("c", "NN", 1), ("b", "NNP", 3), ("d", "NN", 4)])
    merged = vocab.container_union(left, right)
    assert rows(merged, "id", "key", "tag", "freq") == [(0, "a", "NN", 5), (1, "b", "JJ", 5), (2, "c", "NN", 1), (3, "d", "NN", 4)]
    wanted = spark.createDataFrame([("d", 0), ("zz", 1), ("a", 2)], "key string, place int")
    assert rows(vocab.keep_keys(merged, wanted, "place"), "id", "key") == [(0, "d"), (1, "a")]
    assert rows(vocab.remove_keys(merged, wanted), "id", "key") == [(0, "b"), (1, "c")]
    assert rows(vocab.sorted_by(merged, "freq"), "id", "key") == [(0, "a"), (1, "b"), (2, "d"), (3, "c")]
    assert rows(vocab.sorted_by(merged, "freq", descending=False), "id", "key") == [(0, "c"), (1, "d"), (2, "a"), (3, "b")]
    assert rows(vocab.id_slice(merged, 1, 3), "key") == [("b",), ("c",)]
    assert rows(vocab.contained(wanted, merged), "key") == [("a",), ("d",)]
    with pytest.raises(TypeError):
        vocab.container_union(left, right.withColumn("idf", F.lit(1.0)))


def test_multi_hot_counts(spark):
    items = spark.createDataFrame([(1, "a"), (1, "a"), (1, "x"), (2, "b")], "paper_id bigint, key string")
    cells = vocab.multi_hot(items, container(spark, [("a", "NN", 1), ("b", "NN", 1)]))
    assert rows(cells, "paper_id", "id", "n") == [(1, 0, 2), (2, 1, 1)]
    assert rows(vocab.as_sparse_arrays(cells), "paper_id", "indices", "counts") == [(1, [0], [2]), (2, [1], [1])]


def test_describe(spark):
    bank = spark.createDataFrame([("05", 0, "Combinatorics")], "key string, id int, description string")
    assert vocab.describe(bank).first()["line"] == "Code: 05, description: Combinatorics"
    scored = spark.createDataFrame([("w", 0, "NN", 0.5, 1.25)], "key string, id bigint, tag string, idf double, tfidf double")
    assert vocab.describe(scored).first()["line"] == "word: w, POS tag: NN, idf: 0.500, tfidf: 1.250"


def test_lookup_join_on_skewed_keys_equals_plain_join(spark):
    rng = random.Random(5)
    words = ["hot"] * 400 + [f"w{rng.randrange(60)}" for _ in range(600)]
    left = spark.createDataFrame(list(enumerate(words)), "n bigint, key string").repartition(5)
    right = spark.createDataFrame([("hot", 1, 400)] + [(f"w{i}", i, i) for i in range(0, 60, 2)], "key string, id bigint, freq bigint")
    for how in ("inner", "left"):
        plain = rows(left.join(right, "key", how).na.fill(-1), "n", "key", "id")
        for sample in (1.0, 0.01):
            split = lookup.lookup_join(left, right, "key", how, broadcast_bytes=0, hot_keys=3, sample=sample)
            assert rows(split.na.fill(-1), "n", "key", "id") == plain
        assert rows(lookup.lookup_join(left, right, "key", how).na.fill(-1), "n", "key", "id") == plain


def test_tail_of_skewed_join_holds_no_hot_row(spark):
    left = spark.createDataFrame([(i, "hot") for i in range(50)] + [(99, "cold")], "n bigint, key string")
    right = spark.createDataFrame([("hot", 50), ("cold", 1)], "key string, freq bigint")
    plan = lookup.lookup_join(left, right, "key", broadcast_bytes=0, hot_keys=1, sample=1.0)
    assert plan.count() == 51
    assert "LeftAnti" in plan._jdf.queryExecution().toString()


def corpus(spark, lists):
    return spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "paper_id bigint, Abstract array<string>")


def brute_pairs(lists, known, cross):
    flat = [(d, w) for d, words in enumerate(lists) for w in words][:-1]
    kept = [(d, w) for d, w in flat if w in known]
    return Counter((a[1], b[1]) for a, b in zip(kept, kept[1:]) if cross or a[0] == b[0])


LISTS = [["a", "x", "b", "a"], [], ["x"], ["b", "a", "b"], ["c", "a"], ["b", "c", "a", "b", "a"]]


@pytest.mark.parametrize("cross", [True, False])
def test_pairs_cross_unknown_words_and_borders(spark, cross):
    words = container(spark, [("a", "NN", 5), ("b", "JJ", 4), ("c", "NN", 2)])
    stream = phrases.phrase_word_stream(corpus(spark, LISTS), words)
    counts = phrases.context_counts(phrases.pair_counts(stream, cross), words)
    assert {(r["w1"], r["w2"]): r["freq"] for r in counts.collect()} == dict(brute_pairs(LISTS, {"a", "b", "c"}, cross))


def brute_information(pairs, known, zero_cells):
    total = sum(pairs.values())
    first = Counter()
    for (w1, _), n in pairs.items():
        first[w1] += n
    result = {}
    for (w1, w2), n in pairs.items():
        p1, p2 = first[w1] / total, first[w2] / total
        cells = [(total - first[w1] - first[w2] + n, (1 - p1) * (1 - p2)), (first[w2] - n, (1 - p1) * p2), (first[w1] - n, p1 * (1 - p2)), (n, p1 * p2)]
        low = 1 if zero_cells == "drop" else 0
        if any(c < low for c, _ in cells) or any(d <= 0 for _, d in cells):
            result[w1, w2] = 0.0
        else:
            result[w1, w2] = sum(c / total * math.log2(c / total / d) for c, d in cells if c)
    return result


@pytest.mark.parametrize("zero_cells", ["drop", "limit"])
def test_mutual_information(spark, zero_cells):
    rng = random.Random(2)
    lists = [[rng.choice("abcdx") for _ in range(rng.randrange(12))] for _ in range(30)]
    words = container(spark, [(w, "NN", 9 - i) for i, w in enumerate("abcd")])
    stream = phrases.phrase_word_stream(corpus(spark, lists), words)
    scored = phrases.with_words(phrases.mutual_information(phrases.pair_counts(stream), zero_cells), words).collect()
    want = brute_information(brute_pairs(lists, set("abcd"), True), "abcd", zero_cells)
    assert {(r["w1"], r["w2"]): pytest.approx(r["mutual_info"], abs=1e-12) for r in scored} == want
    assert all(r["mutual_info"] >= 0 for r in scored)


@pytest.mark.parametrize("n", [0, 1, 5, 40, 1000])
def test_top_phrases_equals_full_sort(spark, n):
    rng = random.Random(n)
    vocab = spark.createDataFrame([(f"k{i:03d}", (i * 37) % 230, "NN") for i in range(230)], "key string, id bigint, tag string")
    key = {(i * 37) % 230: f"k{i:03d}" for i in range(230)}
    pairs = [(rng.randrange(30), 30 + i, 1, rng.choice([0.0, 0.25, 0.5, rng.random()])) for i in range(200)]
    scored = spark.createDataFrame(pairs, "id1 bigint, id2 bigint, freq bigint, mutual_info double")
    named = [(key[a], key[b], score) for a, b, _, score in pairs if score > 0]
    best = sorted(named, key=lambda p: (-round(p[2], 9), p[0], p[1]))[:n]
    got = rows(phrases.top_phrases(scored, vocab, n), "id", "w1", "w2")
    assert got == [(i, a, b) for i, (a, b) in enumerate(sorted((p[0], p[1]) for p in best))]


def test_phrase_vocab_keys(spark):
    lists = [["red", "car", "red", "car", "blue", "car"], ["red", "car", "blue", "bus"]]
    found = build_phrase_vocab(corpus(spark, lists), tag_by("'NN'"), 1.0, min_freq=2, min_word_len=3)
    keys = [r["key"] for r in found.orderBy("id").collect()]
    assert keys[:3] == ["red", "car", "blue"] and all("_" in k for k in keys[3:])


def test_select_in_vocab(spark):
    papers = spark.createDataFrame([(1, ["a", "b", "c"], "k"), (2, ["z"], "l"), (3, [], "m")], "paper_id bigint, Abstract array<string>, MSCs string")
    words = spark.createDataFrame([("a",), ("a_b",), ("c",)], "key string")
    got = {r["paper_id"]: (r["Abstract"], r["MSCs"]) for r in tokens.select_in_vocab(papers, words).collect()}
    assert got == {1: (["a", "a_b"], "k"), 2: ([], "l"), 3: ([], "m")}
    kept = {r["paper_id"]: r["Abstract"] for r in tokens.select_in_vocab(papers, words, keep_last=True).collect()}
    assert kept[1] == ["a", "a_b", "c"]


def test_tagging(spark):
    toks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "paper_id bigint, pos int, word string")
    lexicon = spark.createDataFrame([("a", "JJ")], "word string, tag string")
    assert rows(tokens.tag_words(toks, lexicon), "word", "tag") == [("a", "JJ"), ("b", "NN")]

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<string>")
    def tagger(words):
        return words.map(lambda ws: ["NNP" if w[0].isupper() else "NN" for w in ws])

    papers = spark.createDataFrame([(1, ["Bob", "eats"])], "paper_id bigint, Abstract array<string>")
    assert rows(tokens.tag_sentences(papers, tagger, "paper_id"), "pos", "word", "tag") == [(0, "Bob", "NNP"), (1, "eats", "NN")]


def test_neighbours_are_added_up_before_they_are_shuffled(spark, monkeypatch):
    lists = [[1, 2] * 50, [], [7], None, [2, 1, 1 << 40, 1 << 40, 1 << 40], [2] * 20]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "paper_id bigint, stream array<bigint>").coalesce(1)
    want = {}
    for x in lists:
        for pair in zip(x or [], (x or [])[1:]):
            want[pair] = want.get(pair, 0) + 1
    rows = phrases._inside_pairs(df).collect()
    assert len(rows) == len(want) and {(r["id1"], r["id2"]): r["freq"] for r in rows} == want
    monkeypatch.setattr(phrases, "HELD", 1)
    assert {(r["id1"], r["id2"]): r["freq"] for r in phrases.pair_counts(df, cross_document=False).collect()} == want


def test_texts_without_math_are_not_searched_for_it(spark):
    texts = ["a $x$ b", "a \\[x\\] b", "\\$y$[z] c", "plain\ntext", "one $ sign", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.select(text.strip_math(F.col("t")).alias("m"), text.clean_words(F.col("t")).alias("w"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" in plan.lower() and "translate" not in plan
    rows = got.collect()
    assert [r["m"] for r in rows] == ["a   b", "a   b", "\\ [z] c", *texts[3:]]
    assert [r["w"] for r in rows] == [["a", "b"], ["a", "b"], ["z", "c"], ["plain", "text"], ["one", "sign"], [], None]
