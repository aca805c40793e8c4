"""Queries against their SQL, and results that SQL cannot state against brute force or held-out labels."""

import html
import math
import re
from collections import Counter

import pytest

import corpus_pipeline
from doclabel.llm import quality, rules
from doclabel.llm.queries import ORACLES, QUERIES, table
from doclabel.staging import stage
from suite import check

CONTRACT = {
    "op1_": "doc_id n_bytes n_removed n_spans kept_sha256", "op2_": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3_": "doc_id size source_size target taken", "op4_": "doc_id", "op5_": "doc_id held_out score predicted",
    "op6_": "doc_id n_bytes n_tokens over_limit", "op7_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_": "page_id url text n_chars", "op9_": "doc_id n_lines n_dropped kept_sha256", "op10_": "doc_id n_shingles component_id kept",
    "op11_": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op12_": "lang rank phrase a l r n score",
    "op13_": "doc_id n_tokens ids_sha256 decoded_sha256",
}
WHITE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name, monkeypatch):
    monkeypatch.setattr(check, "QUERIES", QUERIES)
    monkeypatch.setattr(check, "ORACLES", ORACLES)
    verdict, rows, _, _ = check.compare(spark, con, sf_dir, name)
    assert verdict == "ok" and rows > 0


def test_queries_with_the_contract_columns(spark, sf_dir):
    assert len(QUERIES) == len(CONTRACT) == 13
    for prefix, columns in CONTRACT.items():
        (name,) = [n for n in QUERIES if n.startswith(prefix)]
        if name not in ORACLES:
            assert set(columns.split()) <= set(QUERIES[name](spark, sf_dir).columns)


def test_quality_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table has three held-out rows of label 0
    scored = QUERIES["op5_quality_classifier"](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").filter("held_out").collect()
    good, bad = [r for r in scored if r["quality"] == 1], [r for r in scored if r["quality"] == 0]
    assert good and bad and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    assert sum(r["predicted"] for r in good) >= 0.95 * len(good)
    assert sum(r["predicted"] for r in bad) <= 0.25 * len(bad)


def test_quality_takes_no_label_of_the_held_out_fold(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs, other)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_token_counts_equal_the_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    for r in QUERIES["op6_token_counts"](spark, sf_dir).collect():
        n = len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)


def brute_base(text):
    words = re.findall(WHITE, text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, places = Counter(triples), set()
    for i, t in enumerate(triples):
        if often[t] > 1:
            places |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(WHITE, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(places)


def brute_distances(rows, names):
    """The estimate of one group, step by step in plain numpy."""
    import numpy as np

    x = np.array([[r[n] for n in names] for r in rows])
    scale = np.array([rules.SCALES[n] for n in names])
    width = scale / 16
    bins = np.floor(x / width)
    quantile = lambda v, q: np.sort(v)[max(0, math.ceil(q * len(v)) - 1)]
    q = np.array([[quantile(bins[:, i], s) for i in range(len(names))] for s in (0.25, 0.5, 0.75)])
    starts = [((q[1] + 0.5) * width, np.diag(((q[2] - q[0]) * width / 1.349) ** 2 + scale**2)), (x.mean(0), np.cov(x.T, bias=True) + np.diag(scale**2))]
    ends = []
    for mean, cov in starts:
        for _ in range(rules.STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            b = np.floor(np.log(d + 1e-9) * 50)
            inner = x[b <= quantile(b, rules.INNER)]
            mean, cov = inner.mean(0), rules.CONSISTENCY * np.cov(inner.T, bias=True) + np.diag(scale**2)
        ends.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(ends, key=lambda e: e[0])
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_quality_rules_against_brute_force(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = rules.judge_quality(docs).collect()
    for r in got:
        base = brute_base(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert r["kept"] == (not r["base_failed"] and r["distance"] <= rules.CUTOFF)
    stats = [r for r in rules.base_statistics(docs, "doc_id").collect() if not r["base_failed"]]
    assert len(stats) >= rules.MIN_ROWS
    want = dict(zip([r["doc_id"] for r in stats], brute_distances(stats, list(rules.SCALES))))
    for r in got:
        if not r["base_failed"]:
            assert math.isclose(r["distance"], want[r["doc_id"]], rel_tol=1e-6, abs_tol=1e-6)


def test_quality_rules_keep_clean_and_reject_junk(spark):
    rows = QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("NOT base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1) and not any(r["kept"] for r in rows if r["quality"] == 0)


def test_quality_rules_run_no_python(spark, sf_dir):
    for name in ("op3_source_mixing", "op7_quality_rules"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_pages_against_the_articles(spark, sf_dir):
    """The test pages mark their article, which gives the expected text by another way."""

    def article(page):
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", b))).split()) for b in blocks]
        return "\n".join(b for b in blocks if b)

    pages = {r["page_id"]: r for r in table(spark, sf_dir, "pages").collect()}
    got = QUERIES["op8_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_pipeline_against_plain_python(spark, sf_dir):
    """Each stage on what the one before kept, against a plain version."""
    from .plain import component_roots, contaminated, frequent_lines

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    order = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[0])
    steps = dict(corpus_pipeline.STAGES)

    good = stage(steps["quality_classifier"](spark, docs, sf_dir), "good")
    scored = {r["doc_id"]: r["predicted"] for r in QUERIES["op5_quality_classifier"](spark, sf_dir).collect()}
    assert order(good) == [r for r in order(docs) if scored[r[0]]] and good.columns == columns

    lined = stage(steps["line_dedup"](spark, good, sf_dir), "lined")
    rows = [r.asDict() for r in good.orderBy("doc_id").collect()]
    drop = frequent_lines([r["text"] for r in rows], 10)
    for r in rows:
        kept = [x for x in r["text"].split("\n") if not drop(x)]
        if len(kept) < len(r["text"].split("\n")):
            r |= {"text": "\n".join(kept), "n_chars": len("\n".join(kept))}
    assert order(lined) == [tuple(r[c] for c in columns) for r in rows] and lined.columns == columns

    single = stage(steps["minhash_near_dedup"](spark, lined, sf_dir), "single")
    roots = component_roots({r["doc_id"]: r["text"] for r in rows}, 75)
    rows = [r for r in rows if roots[r["doc_id"]] == r["doc_id"]]
    assert order(single) == [tuple(r[c] for c in columns) for r in rows] and single.columns == columns

    clean = stage(steps["benchmark_decontamination"](spark, single, sf_dir), "clean")
    rows = [r for r in rows if not contaminated(r["text"], bench)[3]]
    assert order(clean) == [tuple(r[c] for c in columns) for r in rows] and clean.columns == columns

    mixed = steps["source_mixing"](spark, clean, sf_dir)
    from doclabel.llm.mixing import mix_plan

    plan = {r["doc_id"]: r["copies"] for r in mix_plan(clean).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in plan.items() if v})
    assert mixed.columns == [*columns, "copy"]
    assert corpus_pipeline.run(spark, sf_dir).count() == sum(plan.values())
