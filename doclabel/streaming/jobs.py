"""Streams over newly landed harvest pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from doclabel.functions.text import clean_words
from doclabel.operators.dictionary import Sent, sent_once
from doclabel.operators.models import Scorer, score_classes
from doclabel.operators.thresholds import DEFAULT_THRESHOLD, predict_thresholds
from doclabel.operators.tokens import select_in_vocab
from doclabel.sources.harvest import harvest_union

# Fixed value: Spark's state store that keeps keys on disk (and in the checkpoint), not on the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deduplicated(stream: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """One row per paper, the first to arrive, although the pages overlap.

    There is no watermark: a page may be of any age and arrive in any order, and
    a copy may follow after any time. State holds one key per paper.
    """
    return stream.dropDuplicates([id_col])


def stream_ingest(stream: DataFrame, out: str, checkpoint: str, id_col: str = "paper_id") -> StreamingQuery:
    """Append each paper once to a parquet table; takes all files landed so far, then stops.

    The first start of a checkpoint chooses the state store; later ones go on with it.
    """
    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        return (
            deduplicated(stream, id_col).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream_revisions(stream: DataFrame, out: str, checkpoint: str, id_col: str = "arXiv_id", latest: str = "Date") -> StreamingQuery:
    """Write the newest record of each paper whenever a newer one arrives; takes all files landed so far, then stops.

    Pages may overlap, repeat and arrive in any order. State holds the newest
    ``latest`` value of each paper, on disk. What a batch changes is written under
    its number and replaces an earlier attempt; :func:`current_records` reads the
    newest of these rows per paper.
    """
    columns, place = stream.columns, stream.columns.index(latest)

    def newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, row = state.get[0] if state.exists else None, None
        for frame in frames:
            for values in frame.itertuples(index=False, name=None):
                if values[place] is not None and (best is None or values[place] > best):
                    best, row = values[place], values
        if row is not None:
            state.update((best,))
            yield pd.DataFrame([row], columns=columns)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    changed = stream.groupBy(id_col).applyInPandasWithState(newest, stream.schema, f"best {stream.schema[latest].dataType.simpleString()}", "update", GroupStateTimeout.NoTimeout)
    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        return changed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before)


def current_records(spark: SparkSession, out: str, id_col: str = "arXiv_id", latest: str = "Date") -> DataFrame:
    """The newest record of each paper that :func:`stream_revisions` has written."""
    return harvest_union(spark.read.parquet(out).drop("batch"), id_col, latest)


def label_papers(
    papers: DataFrame,
    scorer: Scorer,
    vocab: DataFrame | Sent,
    thresholds: list[float] | float = DEFAULT_THRESHOLD,
    id_col: str = "paper_id",
    text: str = "Abstract",
) -> DataFrame:
    """Clean, select words, score classes and predict labels: ``(id_col, p, y_hat)``."""
    cleaned = papers.select(id_col, clean_words(F.col(text)).alias(text))
    selected = select_in_vocab(cleaned, vocab, text)
    return predict_thresholds(score_classes(selected, scorer, id_col, text), thresholds)


def stream_label(
    stream: DataFrame,
    scorer: Scorer,
    vocab: DataFrame,
    out: str,
    checkpoint: str,
    thresholds: list[float] | float = DEFAULT_THRESHOLD,
    id_col: str = "paper_id",
) -> StreamingQuery:
    """Label every micro-batch with a prepared model.

    A batch is written under its number and replaces an earlier attempt, so a
    restarted stream leaves each batch labelled once. Copies of a paper within a
    batch are dropped first; run :func:`stream_ingest` before to drop all copies.
    Vocabulary and model pass the driver once for the stream, not with every batch.
    """
    scorer, vocab = scorer.sent(), sent_once(vocab.select("key"))

    def write(batch: DataFrame, number: int) -> None:
        labelled = label_papers(batch.dropDuplicates([id_col]), scorer, vocab, thresholds, id_col)
        labelled.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
