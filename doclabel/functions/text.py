"""Text cleaning and tokenising as Column expressions."""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define a clean text.
DOLLAR_MATH = r"\$+[^\$]+\$+"
BRACKET_MATH = r"\\\[[^\]]+\]"
DASHES_APOSTROPHES = r"[-']+"
# White space in the Unicode sense; Java's own class is ASCII only. Letters and Latin-1
# characters are listed one by one: Java looks them up in a bit table, which is
# several times faster than testing ranges.
WHITESPACE = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x20\x85\xA0\p{Z}"
NON_ALPHAS = f"[^{ascii_letters}{WHITESPACE}]+"
SPACES = f"[{WHITESPACE}]+"


def strip_math(text: Column) -> Column:
    """Replace dollar math and bracket math by spaces. Texts without their signs are not searched for them."""
    found = F.contains(text, F.lit("$")) | F.contains(text, F.lit("\\["))
    return F.when(found, F.regexp_replace(F.regexp_replace(text, DOLLAR_MATH, " "), BRACKET_MATH, " ")).otherwise(text)


def strip_non_alphas(text: Column) -> Column:
    """Dashes and apostrophes become spaces, other non-letters vanish, newlines become spaces."""
    spaced = F.regexp_replace(text, DASHES_APOSTROPHES, " ")
    return F.replace(F.regexp_replace(spaced, NON_ALPHAS, ""), F.lit("\n"), F.lit(" "))


def clean_text(text: Column) -> Column:
    return strip_non_alphas(strip_math(text))


def whitespace_words(text: Column) -> Column:
    """Split on white space, without empty strings."""
    return F.filter(F.split(text, SPACES), lambda word: word != "")


def clean_words(text: Column) -> Column:
    return whitespace_words(clean_text(text))


def word_candidates(words: Column, keep_last: bool = False) -> Column:
    """Each word followed by the phrase it opens: ``a, a_b, b, b_c, ...``.

    The last word opens no phrase; it is listed only with ``keep_last``.
    """
    following = F.slice(words, F.lit(2), F.size(words))
    last = (lambda word: F.array(word)) if keep_last else (lambda word: F.array().cast("array<string>"))
    return F.flatten(
        F.zip_with(
            words,
            following,
            lambda word, nxt: F.when(nxt.isNull(), last(word)).otherwise(
                F.array(word, F.concat(word, F.lit("_"), nxt))
            ),
        )
    )


def adjacent_pairs(items: Column) -> Column:
    """Array of structs ``(first, second)`` for neighbours in an array."""
    zipped = F.zip_with(
        items,
        F.slice(items, F.lit(2), F.size(items)),
        lambda a, b: F.struct(a.alias("first"), b.alias("second")),
    )
    return F.filter(zipped, lambda pair: pair["second"].isNotNull())


def sample_words(words: Column, key: Column, n_words: int = 25, seed: int = 0) -> Column:
    """``n_words`` drawn with replacement; the draw depends on ``key`` and ``seed`` only.

    Draw k takes the word at md5("key:k:seed") (first 32 bits) modulo the length,
    so any engine can repeat it.
    """

    def draw(k: Column) -> Column:
        digest = F.md5(F.concat_ws(":", key.cast("string"), k.cast("string"), F.lit(str(seed))))
        number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
        return F.get(words, (number % F.size(words)).cast("int"))

    drawn = F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), draw)
    return F.when(F.size(words) > 0, drawn).otherwise(F.array().cast("array<string>"))
