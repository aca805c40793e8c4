"""Every registered query against its SQL, and the shape of the plans that matter at scale."""

import re

import pytest

import __spark_entry__ as entry
from suite import fixtures as fx
from suite.check import compare, connect
from suite.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    verdict, rows, _, _ = compare(spark, con, sf_dir, name)
    assert verdict in ("ok", "rows only") and rows > 0


def test_entry_contract(spark):
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert flagship.columns == ["paper_id", "codes", "words"] and flagship.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


CHECKED = [n for n in QUERIES if n not in ("train_mlp", "predict_mlp", "train_svd_vectors", "train_word2vec", "stream_ingest", "stream_label")]


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_join_and_no_one_task_window(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # A single partition may only receive partial aggregates or a final ordered limit.
    for line in re.findall(r"Window .*", text):
        assert not re.search(r"\], \[\]|windowspecdefinition\((?!class_id)", line) or "class_id" in line


def test_scans_read_only_needed_columns(spark, sf_dir):
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()  # a cached table would stand in for the scan
    text = plan(QUERIES["strip_math"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(fx.vocab(spark, sf_dir).filter("tag = 'NNP'").select("key"))
    assert "EqualTo(tag,NNP)" in text


def test_documents_are_not_shuffled_by_position_splits(spark, sf_dir):
    assert "Exchange" not in plan(QUERIES["split_80_20"](spark, sf_dir))
