"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs three times and its median wall time counts. Stored inputs
(cleaned words, vocabularies, the processed corpus) are written before the clock
starts; ``process_corpus`` starts from the raw texts and includes all of that work.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from doclabel.session import get_session
from suite import fixtures as fx
from suite.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "process_corpus", "tfidf_feature_selection", "unigram_experiment", "fit_thresholds",
    "clean_words", "build_vocab", "top_phrases", "select_in_vocab", "information_gain",
    "predict_unigram", "padded_sequence", "harvest_union",
]


def seconds(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    wanted = sys.argv[1:] or HEADLINE
    spark = get_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    fx.vocab(spark, SF_DIR), fx.corpus(spark, SF_DIR), fx.word_vectors(spark, SF_DIR), fx.harvest_pages(spark, SF_DIR)
    timings = {name: round(statistics.median(seconds(spark, name) for _ in range(RUNS)), 3) for name in wanted}
    print(json.dumps({
        "metric": f"total median seconds of {len(timings)} headline queries, {RUNS} runs each",
        "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
