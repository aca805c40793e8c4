"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; results against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doclabel.llm import buckets, decontaminate, licenses, lines, mixing, neardup, pages, quality, repeats, rules, tokens
from doclabel.llm.common import with_key

from . import plain

# Names that the operators use themselves.
CLASHES = ["_key", "key", "score", "n_words", "hits", "items", "matches", "copy", "size", "target", "drops", "_drops", "lines", "q", "d", "root", "kept", "bucket", "weight", "_mix_on", "_mix_source", "_mix_z", "_mix_t", "_part", "_place"]


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def texts():
    """(doc_id, text): copies, near copies, shared passages and lines, nulls, repeats, one text over a megabyte."""
    rnd = random.Random(11)
    base = [words(rnd, 120) for _ in range(6)]
    passage, line = words(rnd, 40, 9000), "A Common Line"
    rows = [(i, f"{b}\n{line}\n{words(rnd, 10)}") for i, b in enumerate(base)]
    rows += [(10 + i, f"{b} more\n {line.lower()}\t") for i, b in enumerate(base)]
    rows += [(20 + i, rows[i][1]) for i in range(3)]
    rows += [(30 + i, f"{words(rnd, 30)} {passage} {words(rnd, 30)}\n{line}") for i in range(4)]
    rows += [(40, None), (41, ""), (42, " \n\t\n"), (43, "one two"), (44, "ONE two"), (45, "é" * 130), (46, "a" * 400), (47, "x y z\x0b\n\nx y z")]
    rows += [(None, None), (None, base[0]), (None, base[0]), (50, "twice the same row"), (50, "twice the same row"), (50, "another text of the same id"), (-3, words(rnd, 60) + " " + passage)]
    rows.append((60, words(rnd, 230_000, 100_000) + " " + passage + " " + base[1]))
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, [None, "en", "de"][k % 3], [None, "s1", "s2", "ü"][k % 4], k) for k, (i, t) in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n bigint").repartition(4)
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]).cache()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.filter("doc_id = 123456789")


def ordered(rows):
    """Documents in the order the operators define: doc_id, nulls last, then text, nulls last."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode()))


def keyed(df):
    return with_key(df, "_k", "text")


def test_keys_number_repeated_rows(spark, awkward, empty):
    got = keyed(awkward).orderBy("_k").collect()
    assert [r["_k"] for r in got] == list(range(len(texts())))
    assert [(r["doc_id"], r["text"]) for r in got] == ordered(texts())
    unique = awkward.filter("doc_id IS NOT NULL AND doc_id <> 50")
    assert all(r["_k"] == r["doc_id"] for r in keyed(unique).collect())
    assert keyed(empty).count() == 0


@pytest.mark.parametrize("hot_share,bucket_rows", [(5000, 50_000), (3, 50_000), (5000, 1)])
def test_repeats_against_brute_force(spark, awkward, monkeypatch, hot_share, bucket_rows):
    monkeypatch.setattr(repeats, "HOT_SHARE", hot_share)
    monkeypatch.setattr(repeats, "BUCKET_ROWS", bucket_rows)
    df = awkward if hot_share == 5000 else awkward.filter("doc_id < 60 OR doc_id IS NULL")
    rows = [r for r in ordered(texts()) if hot_share == 5000 or r[0] is None or r[0] < 60]
    got = repeats.remove_repeats(keyed(df), "_k").orderBy("_key").collect()
    want = plain.repeats(rows, 100)
    assert len(got) == len(rows)
    for r, (doc_id, text), (kept, gone) in zip(got, rows, want):
        assert (r["doc_id"], r["n_bytes"], bytes(r["kept"])) == (doc_id, len((text or "").encode()), kept)
        starts, ends = r["spans"][0::2], r["spans"][1::2]
        assert all(a > b for a, b in zip(starts[1:], ends)) and sum(ends) - sum(starts) == len(gone)


def test_repeats_of_an_empty_table(empty):
    assert repeats.remove_repeats(keyed(empty), "_k").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_random_bytes(spark, monkeypatch, seed):
    """Short strings over few letters: all paths, many ties, several partitions."""
    rnd = random.Random(seed)
    monkeypatch.setattr(repeats, "HOT_SHARE", [5000, 3, 3][seed])
    monkeypatch.setattr(repeats, "BUCKET_ROWS", [3, 50_000, 4][seed])
    base, rows = "".join(rnd.choice("ab cé") for _ in range(80)), []
    for i in range(40):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30)))
        a = rnd.randint(0, 60)
        text += base[a : a + rnd.randint(0, 60)] + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 20)))
        rows.append((3 * i - 20, text + ("a" * 50 if rnd.random() < 0.2 else "")))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = repeats.remove_repeats(keyed(df), "_k", 12, 8).orderBy("_key").collect()
    assert [bytes(r["kept"]) for r in got] == [kept for kept, _ in plain.repeats(rows, 12)]


def test_bucket_pointers_give_the_suffix_array():
    rnd = random.Random(1)
    for _ in range(50):
        s = np.array([rnd.randrange(3) for _ in range(rnd.randint(1, 60))])
        end = np.full(len(s), len(s))
        pointers = buckets.suffix_pointers(s, end, 60)
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert np.argsort(pointers, kind="stable").tolist() == order
        pointers = buckets.suffix_pointers(s, end, 4)
        same = lambda i, j: s[i : i + 4].tolist() == s[j : j + 4].tolist()
        assert all((pointers[i] == pointers[j]) == same(i, j) for i in range(len(s)) for j in range(len(s)))


ITEMS = [(1, "W1 w2, w3"), (2, None), (3, ""), (None, "one two"), (5, "one two"), (5, "one two"), (10, "zz " * 20)]


def test_decontamination_against_brute_force(spark, awkward, empty, monkeypatch):
    rnd = random.Random(11)
    for _ in range(6):
        words(rnd, 120)
    items = [*ITEMS, (7, "before " + words(rnd, 40, 9000) + " after")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(repr(plain.contaminated(t, items)) for _, t in texts())
    for block_bytes in (decontaminate.BLOCK_BYTES, 60):
        matched, names = decontaminate.match_benchmark(awkward, bench, block_bytes=block_bytes)
        n_hit, bad = decontaminate.judge(matched, names)
        got = matched.select(F.col(names["n_words"]), n_hit, F.col(names["items"]), bad).collect()
        assert sorted(repr((r[0], r[1], list(r[2]), r[3])) for r in got) == want
    longest = matched.select(F.explode(names["matches"]).alias("m")).filter("m.item_id = 7").agg(F.max("m.length")).first()[0]
    assert longest == 40
    kept = decontaminate.remove_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == sum("False)" in w for w in want)
    assert decontaminate.remove_contaminated(empty, bench).count() == 0
    assert decontaminate.remove_contaminated(awkward, bench.filter("item_id = 99")).count() == len(texts())


def test_decontamination_across_shards(monkeypatch):
    """Long texts are searched in shards whose overlap loses no window."""
    rnd = random.Random(2)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 9)
    for _ in range(60):
        docs = [" ".join(rnd.choice(["a", "B", "b", "é", "c1"]) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 5))]
        items = [" ".join(rnd.choice(["a", "b", "É"]) for _ in range(rnd.randint(0, 7))) for _ in range(4)]
        tests = decontaminate.TestSuffixes.of([0, 1, 2, 3], pa.array(items), 4)
        data, offsets = decontaminate.flat_bytes(pa.array(docs))
        found, bounds = decontaminate.hashed_words(data, offsets, decontaminate._INSIDE, decontaminate._LOW)
        which, places = decontaminate._matches(found, bounds, tests, 4) if len(found) and len(tests.starts) else ([], [])
        for r, doc in enumerate(docs):
            hit = set()
            for k, p in zip(which, places):
                if bounds[r] <= p < bounds[r + 1]:
                    hit |= set(range(p, p + tests.lengths[k]))
            assert len(hit) == plain.contaminated(doc, list(enumerate(items)), 4)[1]


def brute_targets(sizes):
    """Water filling, reshared round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {s: 0.0 for s in order}, set()
    left = 1.5 * sum(sizes.values())
    while left > 1e-9 and len(full) < len(order):
        total = sum(weight[s] for s in order if s not in full)
        add = {s: left * weight[s] / total for s in order if s not in full}
        left = 0.0
        for s, x in add.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


def test_mixing(spark, awkward, empty):
    got = mixing.mix_plan(awkward).collect()
    sizes = {}
    for k, (_, text) in enumerate(texts()):
        source = [None, "s1", "s2", "ü"][k % 4]
        sizes[source] = sizes.get(source, 0) + len(re.findall(plain.WHITE, text or ""))
    want = brute_targets(sizes)
    assert len(got) == len(texts())
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] and r["copies"] - r["target"] / max(1, r["source_size"]) < 1 and r["copies"] <= 2
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_plan(awkward.repartition(3)).collect()))
    rows = mixing.mixed_rows(awkward)
    assert rows.columns == [*awkward.columns, "_copy"] and rows.count() == sum(r["copies"] for r in got)
    assert mixing.mix_plan(empty).count() == 0 == mixing.mixed_rows(empty).count()
    silent = awkward.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix_plan(silent).agg(F.sum("taken"), F.max("target")).first() == (0, 0.0)


def test_mixing_many_sources_comes_near_the_targets(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.expr("concat('s', cast(floor(sqrt(id)) % 40 AS string))").alias("source"), F.expr("repeat('w ', 1 + cast(id % 7 AS int))").alias("text"))
    by = mixing.mix_plan(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x"), F.first("source_size").alias("z"))
    for r in by.collect():
        assert r["t"] == pytest.approx(r["x"], rel=0.1) and r["x"] <= 2 * r["z"]


def test_license_scans(spark, awkward, empty):
    mit = licenses.TEMPLATES["mit-notice"].split()
    cut = " ".join(mit[:3] + mit[6:40] + ["other"] + mit[41:])
    docs = spark.createDataFrame([(1, "All rights\nreserved."), (2, "released UNDER the mit license"), (3, f"{words(random.Random(3), 200)} {cut} end"), (4, "released under the gpl license"), (5, None), (5, ""), (None, " ".join(mit[:60]))], "doc_id bigint, text string")
    got = {r["doc_id"]: sorted({m["license"] for m in r["matches"]}) for r in licenses.scan_licenses(docs, licenses.default_templates(spark)).collect()}
    assert got == {1: ["all-rights-reserved"], 2: ["mit"], 3: ["mit-notice"], 4: [], 5: [], None: []}
    templates = licenses.default_templates(spark).union(spark.createDataFrame([(None, "no name here at all"), ("none", None), ("blank", " ")], "license string, text string"))
    many = licenses.scan_licenses(docs, templates, block_bytes=300)
    assert {r["doc_id"]: sorted({m["license"] for m in r["matches"]}) for r in many.collect()} == got
    assert licenses.scan_licenses(awkward, licenses.default_templates(spark)).count() == len(texts())
    assert licenses.scan_licenses(empty, licenses.default_templates(spark)).count() == 0


def test_common_licenses_are_known(spark):
    """Statements as found in the wild, and the names of whole texts; the SQL writes the templates into quotes."""
    assert all(t.isascii() and "'" not in t for t in licenses.TEMPLATES.values())
    wanted = {
        "This project is licensed under the MIT License - see LICENSE.": {"mit-licensed"}, "MIT License\n\nCopyright (c) 2020 Somebody": {"mit-header"},
        "# SPDX-License-Identifier: GPL-2.0-or-later": {"spdx-gpl-2.0"}, "distributed under the GNU Lesser General Public License v2.1": {"lgpl-under"},
        "Released under the GNU Affero General Public License.": {"agpl-under"}, "code is under the ISC license": {"isc"}, "It is under the Unlicense.": {"unlicense"},
        "under the BSD 3-Clause License": {"bsd-3-under"}, "see https://creativecommons.org/licenses/by-nc-sa/3.0/": {"cc-by-nc-sa-3.0-url"}, "CC0: https://creativecommons.org/publicdomain/zero/1.0/": {"cc0-url"},
        "Licensed under the Apache License, Version 2.0.": {"apache-2.0"}, "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0"}, "Nothing is said about a license here.": set(),
    } | {f"Preface. {licenses.TEMPLATES[name]} End.": {name} for name in ["bsd-warranty", "gnu-warranty", "isc-notice", "mit-warranty", "unlicense-dedication", "cc0-deed", "zlib-notice"]}
    gnu = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    wanted |= {gnu.format(a, b): {f"{c}-notice", f"gnu-{b}-or-later"} for a, c in (("", "gpl"), ("Lesser ", "lgpl"), ("Affero ", "agpl")) for b in ("2", "2.1", "3")}
    docs = spark.createDataFrame(list(enumerate(wanted)), "doc_id bigint, text string")
    got = {r["doc_id"]: {m["license"] for m in r["matches"] if m["containment"] == 1} for r in licenses.scan_licenses(docs, licenses.default_templates(spark)).collect()}
    assert [got[i] for i in range(len(wanted))] == list(wanted.values())


def test_license_windows_hold_every_template_and_bands_suffice():
    for n in range(1, 400):
        width, stride = licenses.window_of(n)
        assert all(any(k * stride <= at and at + n <= k * stride + width for k in range(at // stride + 1)) for at in range(60))
        shared = licenses.needed(n, 75)
        jaccard = shared / (width + n - shared)
        assert (1 - jaccard) ** licenses.bands_for(n, width, 75, 1e-6) <= 1e-6 * 1.0001


def test_quality_scores(spark, awkward, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 0), (40, None, 0), (41, 0, 0), (41, 1, 0)], "doc_id bigint, quality int, toxic int")
    scorer = quality.fit_quality(awkward, labels)
    got = quality.score_quality(awkward, scorer)
    assert got.columns == [*awkward.columns, "_score"]
    rows = got.collect()
    assert len(rows) == len(texts()) and all(0 <= r["_score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["_score"]) == r["_score"]
    again = {(r["n"], r["_score"]) for r in quality.score_quality(awkward.repartition(2), quality.fit_quality(awkward.repartition(3), labels)).collect()}
    assert {n for n, _ in again} == {r["n"] for r in rows} and dict(again) == pytest.approx({r["n"]: r["_score"] for r in rows})
    assert quality.score_quality(empty, scorer).count() == 0
    no_labels = quality.fit_quality(awkward, labels.filter("doc_id = -1"))
    assert {r["_score"] for r in quality.score_quality(awkward, no_labels).collect()} == {0.5}
    assert quality.fit_quality(empty, labels).prior > 0


def test_quality_features_of_long_texts():
    """Words of a text of more than a piece are counted once, and none is cut where pieces meet."""
    rnd = random.Random(5)
    long = [f"word{rnd.randrange(3000)}" for _ in range(400_000)]
    long[10:10] = ["x" * ((1 << 20) - 50)]
    few = ["same"] * 300_000
    assert min(len(" ".join(long)), len(" ".join(few))) > 1 << 20
    got = quality.features(pa.array(["a b", " ".join(long), None, " ".join(few), "c c"]))
    for x, ws in zip(got, (["a", "b"], long, [], few, ["c", "c"])):
        n = max(len(ws), 1)
        shares = [sum(len(w) > 20 for w in ws) / n, sum(map(str.__eq__, ws, ws[1:])) / n, sum(map(str.__eq__, ws, ws[2:])) / n]
        want = [np.log1p(sum(map(len, ws)) / n), *np.log1p(50 * np.array(shares)), len(set(ws)) / n, np.log1p(len(ws))]
        assert np.allclose(x[quality.NAMES.index("mean_word") :], want, rtol=1e-12, atol=0)


def test_non_negative_risk_separates_with_unlabelled_text_only():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.5, (4000, 3)), rng.normal(-1, 0.5, (1000, 3))
    scorer = quality.fit_nnpu(good[:1500], np.concatenate([good[1500:], bad]), 2500 / 3500)
    assert (scorer.scores(good) >= 0.5).mean() > 0.97 and (scorer.scores(bad) < 0.5).mean() > 0.97


def test_held_out_fold(spark):
    import zlib

    rows = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return tokens.Counter(file.read())


def test_tokens_spliced_at_proven_boundaries(counter):
    count = lambda s: len(counter.tokenizer.encode(s, add_special_tokens=False).ids)
    rnd = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "'ll", "'s", "1", "é", "ß", "<|endoftext|>", "<|endof", "!", "͸", "中", " ", "xyzzy", "'", " '", "\x1c", " ", "🙂"]
    for _ in range(1500):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 400)))
        assert counter.count(s) == counter.count(s, 100, rnd.choice([70, 80])) == count(s)
    for s in ["a" * 5000, " " * 5000 + "b", "a b" * 3000, "'l" * 900, ("x" * 300 + " ") * 20]:
        assert counter.count(s, 128, 70) == counter.count(s) == count(s)


def test_token_patterns_agree_with_the_library(counter):
    split = lambda s: [o for _, o in counter.tokenizer.pre_tokenizer.pre_tokenize_str(s)]
    for pattern, outside in ((counter.latin, counter.not_latin), (counter.pattern, counter.not_agreed)):
        known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and outside.search(chr(c)) is None]
        assert len(known) > 700
        for at in range(0, len(known), 2000):
            s = "".join(f"a{c}1{c}!{c} {c}{c}" for c in known[at : at + 2000])
            assert split(s) == [m.span() for m in pattern.finditer(s)]


def test_token_counts_of_awkward_rows(spark, awkward, empty, counter):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokens.count_tokens(awkward, path).collect()
    want = [(i, len((t or "").encode()), len(counter.tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in texts()]
    assert sorted(map(repr, ((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got))) == sorted(map(repr, want))
    assert tokens.count_tokens(empty, path).count() == 0


def test_quality_rules_of_awkward_rows(spark, awkward, empty):
    from .test_llm_queries import brute_base

    got = rules.judge_quality(awkward).collect()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == sorted(repr((i, *brute_base(t))) for i, t in texts())
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # fewer rows than an estimate needs
    assert rules.judge_quality(empty).count() == 0


def test_pages_of_other_kinds(spark):
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site name</h1></header>
      <div class="cookie-notice">We use cookies a lot and this is a rather long notice text that goes on and on.</div>
      <div id="content"><h2>Title &amp; more</h2><p>First para with <a href=x>link</a> text&nbsp;here,
      long enough to be seen as content by ratio.</p><p>Short.</p><ul><li>one</li><li>two<li>three</ul>
      <p>Second long paragraph of the article that tells the story in many words and so on.</div>
      <div class="sidebar"><p>Sidebar long text that should not be in the article text at all, never.</p></div>
      <form><p>Search</p></form><div id="comments"><p>I really liked this article and write a long comment about it here.</p></div>
      <script>if (a < b) document.write("<p>no</p>")</script><footer>bye</footer></body>"""
    want = "Title & more\nFirst para with link text here, long enough to be seen as content by ratio.\nShort.\none\ntwo\nthree\nSecond long paragraph of the article that tells the story in many words and so on."
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<nav><p>x"), (4, "x", "plain &lt;text"), (4, "x", "plain &lt;text"), (5, "y", "<p>" * 20_000 + "deep")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("own"))
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in pages.extract_text(df).collect()), key=repr)
    texts_ = [want, "", "", "", "plain <text", "plain <text", "deep"]
    assert got == sorted(((i, u, t, len(t)) for (i, u, _), t in zip(rows, texts_)), key=repr)
    assert pages.extract_text(df.filter("page_id = 99")).count() == 0


LONG = "A long paragraph of the article that tells its story in many plain words and goes on and on."


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "page-with-comments", "elementor-widget", "sidebar-left", "widget"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_names_on_the_content_of_pages(name, attribute):
    """What has a sidebar, or holds most of the page, is no sidebar; the sidebar in it is."""
    page = f"""<body><div class="site-title">My site</div><div {attribute}="{name}"><div class="entry"><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>
      <div class="sidebar"><p>Sidebar text that has nothing to do with it.</p></div><div class="site-footer">Imprint and more</div></div></body>"""
    assert pages.main_text(page) == f"Title\n{LONG}\nShort.\n{LONG}"


def test_names_that_cover_the_page_together():
    posts = "".join(f'<div class="reply"><p>{LONG} {n}</p></div>' for n in range(9))
    want = "\n".join(f"{LONG} {n}" for n in range(9))
    assert pages.main_text(f"<div>Forum</div><div class=list>{posts}</div><div class=ad><p>{LONG}</p></div>") == want
    assert pages.main_text(f"<div class=ad>{LONG}</div><article><h1>Title</h1><p>Brief.</p></article>") == "Title\nBrief."


def test_regions_of_pages():
    """The region holds all of the content, its title and its lead, whatever the share of its parts."""
    paragraphs = [f"{LONG} {n}" for n in range(8)]
    blocks = [f"<p>{p}</p>" for p in paragraphs]
    aside = "<div><p>Menu</p><p>Log in</p><p>Help</p><p>Jobs</p></div>"
    page = f"<body>{aside}<div id=content><h1>Title</h1><p>Lead.</p><div class=entry>{''.join(blocks)}</div></div>{aside}"
    assert pages.main_text(page) == "\n".join(["Title", "Lead.", *paragraphs])
    for whole in ("<body>%s<div><div>%s</div><div>%s</div></div>%s", "<body>%s<main><article>%s</article><article>%s</article></main>%s"):
        assert pages.main_text(whole % (aside, "".join(blocks[:6]), "".join(blocks[6:]), aside)) == "\n".join(paragraphs)
    assert pages.main_text(f"<body><div><h1>Site</h1></div><article><h1>Title</h1>{blocks[0]}<p>Brief.</p></article>{aside}") == f"Title\n{paragraphs[0]}\nBrief."
    items = "".join(f"<li>{p}</li>" for p in paragraphs)
    assert pages.main_text(f"<body>{aside}<div><ul>{items}<li>End</li></ul></div>{aside}") == "\n".join([*paragraphs, "End"])


def test_silent_elements_end():
    for closed in ("<svg viewBox='0 0 9 9'/>", "<math/>", "<svg><svg/><path d='M0'/></svg>", "<button><svg/></button>"):
        assert pages.main_text(f"<body><p>{LONG}</p>{closed}<p>{LONG}</p></body>") == f"{LONG}\n{LONG}"
    for end in ("</body>", "</html>"):
        assert pages.main_text(f"<body><p>{LONG}</p><svg>icon{end}<p>{LONG}</p>") == f"{LONG}\n{LONG}"


def test_text_to_tag_clusters():
    values = pages.smoothed([0, 0, 9, 9, 9, 0], 1.0)
    assert len(values) == 6 and values[3] > pages.threshold(values) > values[0]
    assert pages.threshold([2.0, 2.0]) < 2.0


def test_line_dedup_of_awkward_rows(spark, awkward, empty):
    rows = texts()
    drop = plain.frequent_lines([t for _, t in rows], 10)
    want = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not drop(x)]
        want.append((i, "\n".join(kept), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept)))
    assert sum(w[3] for w in want) >= 16
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(awkward).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    whole = lines.dedup_texts(awkward)
    assert whole.columns == awkward.columns
    assert sorted(repr((r["doc_id"], r["text"] or "")) for r in whole.collect()) == sorted(repr((w[0], w[1])) for w in want)
    assert lines.dedup_lines(empty).count() == 0 == lines.dedup_texts(empty).count()


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_line_runs_do_not_depend_on_batches(spark, batches, fanout):
    rnd = random.Random(4)
    rows = [(i, "\n".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    drop = plain.frequent_lines([t for _, t in rows], 6)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, 6, 1, batches, fanout).collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if not drop(x)) for i, t in rows}


def test_near_duplicates_of_awkward_rows(spark, awkward, empty):
    got = neardup.near_duplicates(keyed(awkward), "_k").collect()
    rows = ordered(texts())
    roots = plain.component_roots(dict(enumerate(t for _, t in rows)), 75)
    assert len(got) == len(rows)
    for r in got:
        k = r["_k"]
        assert (r["doc_id"], r["root"], r["component_id"]) == (rows[k][0], roots[k], rows[roots[k]][0])
        assert r["n_shingles"] == len(plain.shingles(rows[k][1])) and r["kept"] == (roots[k] == k)
    kept = neardup.dedup_documents(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(roots.values()))
    assert neardup.near_duplicates(keyed(empty), "_k").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_chains_of_near_copies_lose_no_link(spark, monkeypatch, seed):
    """Copies of copies: members far from a bucket's first are reached through others, in one block or many."""
    rnd = random.Random(seed)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", [1000, 2][seed])
    rows, text = [], [f"t{i}" for i in range(80)]
    for i in range(60):
        if i % 12 == 0:
            text = [f"g{i}x{j}" for j in range(80)]
        text = list(text)
        text[rnd.randrange(80)] = f"n{i}"
        rows.append((rnd.randrange(10**6), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(keyed(df), "_k").collect()}
    assert got == plain.component_roots(dict(rows), 75) and len(set(got.values())) < 30


@pytest.mark.parametrize("seed", range(4))
def test_blocks_of_a_bucket_lose_no_link(seed):
    """All that sizes and rare shingles allow is found, once over several buckets and pairs of blocks."""
    rnd = np.random.default_rng(seed)
    base = np.sort(rnd.choice(10**6, 60, replace=False)).astype(np.uint64)
    sets = [np.unique(np.concatenate([rnd.choice(base, rnd.integers(38, 60), replace=False), rnd.integers(0, 40, rnd.integers(0, 9)).astype(np.uint64)])) for _ in range(50)]
    n = np.array([len(s) for s in sets])
    df = {x: sum(x in s for s in map(set, sets)) for x in set(np.concatenate(sets).tolist())}
    common = np.array([sum(df[x] > 3 for x in s.tolist()) for s in sets])
    high = common * 100 // 75 - n + common
    keys, roots = np.arange(50) * 7, rnd.integers(0, 30, 50)
    held = [np.flatnonzero(rnd.random(6) < 0.6) for _ in sets]  # buckets of each member
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def joined(pairs):
        parent.clear()
        parent.update({int(r): int(r) for r in range(30)})
        for a, b in pairs:
            parent[find(int(roots[a // 7]))] = find(int(roots[b // 7]))
        return {frozenset(r for r in range(30) if find(r) == find(s)) for s in range(30)}

    got = []
    for bucket in range(6):
        for i in range(3):
            for j in range(i, 3):
                at = np.array([k for k in range(50) if bucket in held[k] and k % 3 in (i, j)])
                got += neardup.block_links(bucket, i == j, at % 3, keys[at], roots[at], n[at], high[at], [held[k] for k in at], [sets[k] for k in at], 75)
    want = []
    for a in range(50):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            shared_rare = any(df[x] <= 3 for x in np.intersect1d(sets[a], sets[b]).tolist())
            if set(held[a]) & set(held[b]) and 100 * both >= 75 * (n[a] + n[b] - both) and not shared_rare:
                want.append((keys[a], keys[b]))
    special = [(keys[a], keys[b]) for a in range(50) for b in range(a) if set(held[a]) & set(held[b]) and any(df[x] <= 3 for x in np.intersect1d(sets[a], sets[b]).tolist())
               and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    assert want and joined(got + special) == joined(want + special)
    for a, b in got:
        assert 100 * len(np.intersect1d(sets[a // 7], sets[b // 7])) >= 75 * len(np.union1d(sets[a // 7], sets[b // 7]))


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {x: got.get(x, x) for x in linked} == {x: find(x) for x in linked}


def test_similarity_border():
    """75 of 100 is linked, 74 of 99 is not; hashes are those of sets, in any order of words."""
    a, b = (list(neardup.shingle_sets(pa.array([t])))[0] for t in ("a b c d e f g h", "A B c d e f g h"))
    assert (a == b).all() and len(a) == 4
    assert [len(s) for s in neardup.shingle_sets(pa.array(["", "a b", " \x0b", None, "a b c d e"]))] == [0, 1, 0, 0, 1]
    values = neardup.MinMax(4, 3).buckets(a)
    assert len(values) == 4 and hashlib.sha256(values.tobytes()).digest() == hashlib.sha256(neardup.MinMax(4, 3).buckets(b).tobytes()).digest()
