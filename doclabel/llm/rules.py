"""Quality rules: robust multivariate outliers per language and source, native DataFrame operations only.

Fixed rules fail a text first. Of the others, a vector of transformed statistics
is compared with its group's minimum-covariance-determinant estimate: from two
starts (median with quartile scale, mean with covariance) the three quarters of
the rows with the least Mahalanobis distance are re-estimated again and again,
and the end with the smaller determinant counts. Medians and quantiles come from
histograms, all else from sums, so a group of any size is pre-aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclabel.llm.common import WHITE, WORD
from doclabel.operators.lookup import lookup_join
from doclabel.staging import stage

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
# Statistics and the deviation below which a difference says nothing (added to the spread of every group).
SCALES = {"word_length": 0.05, "symbols": 0.01, "capitals": 0.01, "punctuation": 0.01, "repeats": 0.1}
INNER, STEPS = 0.75, 3
CONSISTENCY = 1.41  # fixed value: covariance of normal data over that of its inner three quarters, 5 dimensions
CUTOFF = 45.0  # fixed value: chi-square, 5 degrees of freedom, at about 1.5e-8; text statistics have long tails
MIN_ROWS = 100  # smaller groups use the estimate of their language, or of all rows

_NAMES = list(SCALES)
_PAIRS = [(i, j) for i in range(len(_NAMES)) for j in range(i + 1)]


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def base_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the statistics, per row."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(*keep, text.alias("t"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("w"), F.split(text, "\n").alias("l"))
    word_line = lambda line: F.btrim(line, F.lit(WHITE)) != ""
    triple = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    counted = read.select(
        *keep, F.size("w").cast("bigint").alias("n_words"), F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"), F.regexp_count("t", F.lit(r"[A-Z]")).alias("caps"),
        F.regexp_count("t", F.lit(r"[!-/:-@\[-`{-~]")).alias("points"), F.filter("l", word_line).alias("l"),
        F.when(F.size("w") >= 4, triple).otherwise(F.array().cast("array<bigint>")).alias("g"))
    # Only texts in which some triple repeats are sorted by triple.
    repeats = F.size("g") > F.size(F.array_distinct("g"))
    placed = counted.withColumn("s", F.when(repeats, F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda x, k, step: F.coalesce(F.get("s", k + step)["x"] == x["x"], F.lit(False))
    twice = F.filter("s", lambda x, k: same(x, k, -1) | same(x, k, 1))
    found = placed.withColumn("p", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    # Windows of three words from the repeated places, overlaps counted once.
    reach = F.aggregate(F.transform("p", lambda x, k: F.coalesce(F.least(F.get("p", k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return found.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(reach, F.lit(0)).cast("bigint").alias("n_repeat_words"), "caps", "points",
    ).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.log(chars / n).alias("word_length"), (F.col("n_symbols") / chars).alias("symbols"), (F.col("caps") / chars).alias("capitals"),
        (F.col("points") / chars).alias("punctuation"), (F.col("n_repeat_words") / n).alias("repeats"))


def _group(level: int, *columns: str) -> Column:
    """A number that names a group; null is a value of its own."""
    return F.xxhash64(F.lit(level), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def _quantile(hist: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """The first bin at which ``share`` of a group's rows is reached; ``hist`` has (keys, bin, n)."""
    up_to = W.partitionBy(*keys).orderBy("bin")
    reached = hist.withColumn("up", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
    return reached.filter(F.col("up") >= share * F.col("all")).groupBy(*keys).agg(F.min("bin").alias(name))


def _factored(params: DataFrame) -> DataFrame:
    """Add the inverse Cholesky factor (m_ij) and the log determinant to (g, s, n, mean_i, cov_ij)."""
    out = params
    for i, j in _PAIRS:
        rest = [F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)]
        value = F.col(f"cov_{i}{j}") - _sum(rest) if rest else F.col(f"cov_{i}{j}")
        out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l_{j}{j}"))
    for i in range(len(_NAMES)):
        for j in range(i + 1):
            value = F.lit(1.0) if i == j else -_sum([F.col(f"l_{i}{k}") * F.col(f"m_{k}{j}") for k in range(j, i)])
            out = out.withColumn(f"m_{i}{j}", value / F.col(f"l_{i}{i}"))
    logs = _sum([2 * F.log(f"l_{i}{i}") for i in range(len(_NAMES))])
    return out.select("g", "s", "n", *[f"mean_{i}" for i in range(len(_NAMES))], *[f"m_{i}{j}" for i, j in _PAIRS], logs.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of the statistics, with the group's factor in the same row."""
    parts = [_sum([F.col(f"m_{i}{j}") * (F.col(_NAMES[j]) - F.col(f"mean_{j}")) for j in range(i + 1)]) for i in range(len(_NAMES))]
    return _sum([p * p for p in parts])


def _floor(i: int, j: int) -> float:
    return SCALES[_NAMES[i]] ** 2 if i == j else 0.0


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """(g, s, n, mean_i, cov_ij) of rows grouped by (g, s)."""
    sums = [F.avg(x).alias(f"mean_{i}") for i, x in enumerate(_NAMES)] + [F.avg(F.col(_NAMES[i]) * F.col(_NAMES[j])).alias(f"p_{i}{j}") for i, j in _PAIRS]
    got = rows.groupBy("g", "s").agg(F.count("*").alias("n"), *sums)
    cov = [(factor * (F.col(f"p_{i}{j}") - F.col(f"mean_{i}") * F.col(f"mean_{j}")) + _floor(i, j)).alias(f"cov_{i}{j}") for i, j in _PAIRS]
    return got.select("g", "s", "n", *[f"mean_{i}" for i in range(len(_NAMES))], *cov)


def _beside(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Each row once with each estimate of its group. The estimates, one row per group, go to the rows: no group meets in a task."""
    others = [c for c in params.columns if c != "g"]
    per_group = stage(params.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(*others))).alias("e")), "estimates")
    return lookup_join(rows, per_group, "g").select(*rows.columns, F.explode("e").alias("e")).select(*rows.columns, "e.*")


def covariance_estimates(rows: DataFrame, steps: int = STEPS, inner: float = INNER) -> DataFrame:
    """Minimum-covariance-determinant estimate of every group ``g``: size n, mean_i and inverse factor m_ij."""
    width = {x: SCALES[x] / 16 for x in _NAMES}
    values = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) / width[x]).alias("bin")) for i, x in enumerate(_NAMES)])).alias("v"))
    hist = stage(values.groupBy("g", "v.i", "v.bin").agg(F.count("*").alias("n")), "histogram")
    at = reduce(lambda a, b: a.join(b, ["g", "i"]), [_quantile(hist, ["g", "i"], q, f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))])
    wide = at.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col(f"q{k}"))).alias(f"q{k}_{i}") for i in range(len(_NAMES)) for k in range(3)])
    first = wide.select(
        "g", F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("n"),
        *[((F.col(f"q1_{i}") + 0.5) * width[x]).alias(f"mean_{i}") for i, x in enumerate(_NAMES)],
        *[(F.pow((F.col(f"q2_{i}") - F.col(f"q0_{i}")) * width[_NAMES[i]] / 1.349, 2) + _floor(i, i) if i == j else F.lit(0.0)).alias(f"cov_{i}{j}") for i, j in _PAIRS])
    second = _moments(rows.withColumn("s", F.lit(1)), 1.0)
    params = stage(_factored(first.unionByName(second)), "estimates")
    for _ in range(steps):
        place = F.floor(F.log(_distance() + 1e-9) * 50)
        counts = _beside(rows, params.drop("n")).groupBy("g", "s", place.alias("bin")).agg(F.count("*").alias("n"))
        limited = params.drop("n").join(_quantile(stage(counts, "distances"), ["g", "s"], inner, "limit"), ["g", "s"])
        params = stage(_factored(_moments(_beside(rows, limited).filter(place <= F.col("limit")), CONSISTENCY)), "estimates")
    best = params.groupBy("g").agg(F.min_by("s", "log_det").alias("s"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("rows"))
    return params.join(best, ["g", "s"]).join(sizes, "g").drop("s", "n", "log_det").withColumnRenamed("rows", "n")


def judge_quality(docs: DataFrame, cutoff: float = CUTOFF, min_rows: int = MIN_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, distance, kept.

    Null or empty texts have no words and fail the base rules. A null language or
    source is a value of its own. Groups of fewer than ``min_rows`` rows that
    pass the base rules take the estimate of their language, or else of all rows;
    with fewer than ``min_rows`` in all, only the base rules decide. Rows with
    null or repeated ids are judged one by one. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    keys = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    grouped = keys.select("doc_id", "text", _group(2, "lang", "source").alias("g2"), _group(1, "lang").alias("g1"), _group(0).alias("g0"))
    stats = stage(base_statistics(grouped, "doc_id", "g2", "g1", "g0"), "statistics")
    passed = stats.filter("NOT base_failed")
    rows = passed.select(F.explode(F.array("g2", "g1", "g0")).alias("g"), *_NAMES)
    estimates = stage(covariance_estimates(rows).filter(F.col("n") >= min_rows), "estimates")
    # Every group's finest level with rows enough: one row per group, never one per document.
    levels = passed.select("g2", "g1", "g0").distinct()
    ranked = levels.select("g2", F.posexplode(F.array("g2", "g1", "g0")).alias("level", "g")).join(estimates, "g")
    finest = ranked.groupBy("g2").agg(F.min("level").alias("level"))
    chosen = stage(ranked.join(finest, ["g2", "level"]).drop("g", "level", "n"), "chosen")
    judged = lookup_join(stats, chosen, "g2", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"))
