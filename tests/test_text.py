import re
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclabel.functions import text


def expected_words(value):
    value = re.sub(r"\$+[^\$]+\$+", " ", value)
    value = re.sub(r"\\\[[^\]]+\]", " ", value)
    value = re.sub(r"[-']+", " ", value)
    return re.sub(r"[^a-zA-Z\s]+", "", value).split()


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("value", "words"),
    [
        ("Let $x^2$ be", ["Let", "be"]),
        ("A $$\\sum x$$ sum", ["A", "sum"]),
        ("See \\[ a + b \\] here", ["See", "here"]),
        ("well-known Euler's", ["well", "known", "Euler", "s"]),
        ("H2O 42", ["HO"]),
        ("foo.bar", ["foobar"]),
        ("café naïve", ["caf", "nave"]),
        ("a b\nc", ["a", "b", "c"]),
        ("", []),
        ("one", ["one"]),
        ("price $5 only", ["price", "only"]),
    ],
)
def test_clean_words(spark, value, words):
    assert one(spark, value, text.clean_words) == words == expected_words(value)


def test_strip_functions(spark):
    assert one(spark, "a $x$ b \\[y] c", text.strip_math) == "a   b   c"
    assert one(spark, "a-b\nc.d", text.strip_non_alphas) == "a b cd"
    assert one(spark, "Keep Case", text.clean_text) == "Keep Case"


def test_white_space_is_that_of_python(spark):
    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF]
    frame = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    spaces = frame.filter(F.col("c").rlike(f"^{text.SPACES}$"))
    assert {r["p"] for r in spaces.collect()} == {p for p in points if re.fullmatch(r"\s", chr(p))}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab $\\[]-'.1\n é", max_size=30), min_size=1, max_size=20))
def test_clean_words_random(spark, values):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    got = {r["i"]: r["w"] for r in frame.select("i", text.clean_words(F.col("t")).alias("w")).collect()}
    assert got == {i: expected_words(v) for i, v in enumerate(values)}


@pytest.mark.parametrize(
    ("words", "keep_last", "want"),
    [
        (["a", "b", "c"], False, ["a", "a_b", "b", "b_c"]),
        (["a", "b"], True, ["a", "a_b", "b"]),
        (["a"], False, []),
        (["a"], True, ["a"]),
        ([], False, []),
    ],
)
def test_word_candidates(spark, words, keep_last, want):
    frame = spark.createDataFrame([(words,)], "w array<string>")
    assert frame.select(text.word_candidates(F.col("w"), keep_last)).first()[0] == want


def test_sample_words(spark):
    frame = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "id bigint, w array<string>")
    drawn = {r["id"]: r["s"] for r in frame.select("id", text.sample_words(F.col("w"), F.col("id"), 25, 3).alias("s")).collect()}
    assert len(drawn[1]) == 25 and set(drawn[1]) <= {"a", "b", "c"} and len(set(drawn[1])) > 1
    assert drawn[2] == []
    again = frame.repartition(3).select("id", text.sample_words(F.col("w"), F.col("id"), 25, 3).alias("s"))
    assert {r["id"]: r["s"] for r in again.collect()} == drawn
