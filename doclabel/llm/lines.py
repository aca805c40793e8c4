"""Line dedup over levelled sorted runs of line hashes; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclabel.llm.common import WHITE, ascii_lower, drop_table, fresh, with_key
from doclabel.staging import stage

MIN_DOCS, MIN_CHARS, BATCHES, FANOUT = 10, 1, 4, 2
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def hashed_lines(docs: DataFrame, key: str, min_chars: int) -> DataFrame:
    """One row per line that counts: document key, place, and 128 bits of the line's key."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select(key, "pos", line_key(F.col("line")).alias("k")).filter(F.char_length("k") >= min_chars)
    return keyed.select(key, "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), F.reverse("k")).alias("h2"))


class LineRuns:
    """Runs of (hash, number of documents), sorted by hash, in levels that are compacted when full.

    A batch is anti-joined with the keys that have reached ``threshold`` already,
    which need no more counting, and what is left becomes a new run of level 0.
    ``fanout`` runs of one level are merged into one of the next. Runs are tables
    in the shared folder, so a lost executor costs no more than its task.
    """

    def __init__(self, threshold: int = MIN_DOCS, fanout: int = FANOUT):
        self.threshold, self.fanout, self.levels = threshold, fanout, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        together = runs[0]
        for run in runs[1:]:
            together = together.unionByName(run)
        return together.groupBy(HASH).agg(F.sum("n").alias("n"))

    def closed(self) -> DataFrame | None:
        """Keys that have reached the threshold, from all runs."""
        runs = self.runs()
        return self._merged(runs).filter(F.col("n") >= self.threshold).select(HASH) if runs else None

    def add(self, batch: DataFrame) -> None:
        """Count a batch of (h1, h2, document key) rows in which a pair may repeat."""
        counts = batch.distinct().groupBy(HASH).agg(F.count("*").alias("n"))
        known = self.closed()
        if known is not None:
            counts = counts.join(known, HASH, "left_anti")
        self._put(0, counts)

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(stage(run.sortWithinPartitions(HASH), "run"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(full))
            for old in full:
                drop_table(old)


def dropped_places(keyed: DataFrame, key: str, min_docs: int, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """(key, drops): the sorted places of a document's lines whose key is found in ``min_docs`` documents and more."""
    lines = stage(hashed_lines(keyed, key, min_chars), "lines")
    index = LineRuns(min_docs, fanout)
    for batch in range(batches):
        index.add(lines.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == batch).select(*HASH, key))
    frequent = stage(index.closed(), "frequent")
    # Spark joins the frequent keys map-side if their files are small, else it sorts and splits hot keys.
    return lines.join(frequent, HASH).groupBy(key).agg(F.sort_array(F.collect_list("pos")).alias("drops"))


def _kept_text(lines: Column, drops: Column) -> Column:
    """The lines between dropped places, joined again: linear in the lines."""
    before = lambda j: F.when(j > 0, F.get(drops, j - 1)).otherwise(-1)
    until = lambda j: F.coalesce(F.get(drops, j), F.size(lines))
    pieces = F.transform(F.sequence(F.lit(0), F.size(drops)), lambda j: F.slice(lines, before(j) + 2, until(j) - before(j) - 1))
    return F.array_join(F.when(F.size(drops) > 0, F.flatten(pieces)).otherwise(lines), "\n")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Drop all lines whose key is found in at least ``min_docs`` documents.

    Returns per row of ``docs``: doc_id, the row's key ``_key``, text (the kept
    lines joined by newline), n_lines, n_dropped.

    Null or empty text: one empty line, which no key of ``min_chars`` >= 1
    matches. Rows that repeat a doc_id, or have none, count as documents of
    their own. A line may repeat in its document and counts once there. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    keyed = with_key(docs, "_key", "text")
    drops = dropped_places(keyed, "_key", min_docs, min_chars, batches, fanout)
    rows = keyed.join(drops, "_key", "left").select(
        "_key", "doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    return rows.select(
        "doc_id", "_key", _kept_text(F.col("lines"), F.col("drops")).alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"), F.size("drops").cast("bigint").alias("n_dropped"))


def dedup_texts(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with frequent lines dropped from ``text``, all other columns unchanged.

    Texts without a frequent line stay as they are. A column ``n_chars`` is set to
    the new length where a text changed. Rows whose text loses all lines with a
    word stay, with what is left.
    """
    key, found = fresh(docs, "_key"), fresh(docs, "_drops")
    keyed = with_key(docs, key, *[c for c in docs.columns if c != "doc_id"])
    drops = dropped_places(keyed, key, min_docs, min_chars, batches, fanout).withColumnRenamed("drops", found)
    split = fresh(docs, "_lines")
    rows = keyed.join(drops, key, "left").withColumn(split, F.when(F.col(found).isNotNull(), F.split("text", "\n")))
    text = F.when(F.col(found).isNotNull(), _kept_text(F.col(split), F.col(found))).otherwise(F.col("text"))
    out = rows.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col(found))
    if "n_chars" in docs.columns:
        size = F.when(F.col(found).isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size)
    return out.select(docs.columns)
