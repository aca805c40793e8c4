"""Prefix trie, collocations and byte-level BPE against plain Python and the library."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from doclabel.llm import bpe, collocations, trie
from doclabel.llm.queries import QUERIES, table

from .plain import WHITE, lower, sha

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- byte-level BPE ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as file:
        return bpe.Encoder(file.read(), tuple(bpe.spelled_out(public_tokenizers.PATTERN, below) for below in bpe.TIERS))


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_every_code_point_is_split_as_by_the_library(encoder, library):
    for start in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}.{chr(c)}  {chr(c)}\n {chr(c)}" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert ids_of(encoder.encode([text])[0]) == library.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(20))
def test_random_texts_are_encoded_as_by_the_library(encoder, library, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(bpe, "MEMO", rnd.choice([1, 50, 10**6]))
    monkeypatch.setattr(bpe, "GROUP", rnd.choice([7, 300, 1 << 18]))
    parts = ["a", "b", "the", "  ", "\n", "'s", "é", "😀", "1", "#", " ", "ing", "　", "中", "<|endoftext|>", "xy" * 60]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(200))) for _ in range(20)]
    assert [ids_of(p) for p in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 4097, 60_000])
def test_long_pieces(encoder, library, n):
    for text in ("a" * n, "xyzzy" * n, "é" * n, "=" * n):
        assert ids_of(encoder.encode([text])[0]) == library.encode_ordinary(text)


def test_one_tree_and_many_trees_agree(encoder):
    rnd = random.Random(3)
    pieces = [bytes(rnd.randrange(256) if rnd.random() < 0.2 else rnd.choice(b"abcdeinrst") for _ in range(rnd.randint(5, 8))) for _ in range(500)]
    pieces = [p for p in pieces if p not in encoder.ranks]
    assert [ids_of(p) for p in bpe.merge_pieces(pieces, encoder.pairs)] == [bpe.merge_piece(p, encoder.ranks) for p in pieces]


def test_bpe_query_against_the_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op13_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]].encode())


def test_bpe_of_nulls_repeats_empty_tables_and_clashing_names(spark, library):
    rows = [(1, None, 5), (1, "two words", 6), (1, "two words", 6), (None, "é" * 3000, 7), (2, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").withColumnRenamed("ids", "n_tokens")
    encoded = bpe.encode_texts(docs, VOCABULARY, public_tokenizers.PATTERN)
    got = bpe.decode_ids(encoded, VOCABULARY).collect()
    want = sorted((str(i), (t or "").encode(), len(library.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]), r["n_tokens"]) for r in got) == want
    assert bpe.decode_ids(bpe.encode_texts(docs.filter("doc_id = 9"), VOCABULARY, public_tokenizers.PATTERN), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        bpe.decode_ids(encoded, VOCABULARY, name="IDS")


# --- conversation prefix trie -----------------------------------------------------------


def plain_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, ids in members.items():
        below = [k for k in members if k[: len(node)] == node]
        children = [k for k in below if len(k) == len(node) + 1]
        leaves = [k for k in below if not any(j[:-1] == k for j in members if j)]
        saved = sum((len(members[k]) - 1) * len(re.findall(WHITE, k[-1][1])) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in ids if len(rebuilt[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children), len(leaves), saved, sha(ends.encode())))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-5, 3 * n), n):
        for turn in range(rnd.randint(1, 5)):
            rows.append((c, rnd.choice([turn, turn, turn, None, 1]), rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "a b c", "", None, "ä\x0bb  c"])))
    rows += [(1000 + i, t, "user", f"turn {t} of all") for i in range(60) for t in range(3)]
    rows += [(5, 1, "user", "a b"), (5, 1, "user", "a b"), (None, 1, "user", "nobody"), (7000, 0, "system", "long " * 70_000)]
    rows += [(7001, t, "user", f"{t}") for t in range(150)]
    return rows


@pytest.mark.parametrize("members,shard,crown", [(64, 1 << 18, 1 << 20), (1, 20, 1 << 20), (3, 20, 1 << 20), (1, 10, 30), (10**6, 50, 1 << 20)])
def test_trie_against_brute_force(spark, monkeypatch, members, shard, crown):
    """One shard, many shards, all nodes in the crown, and none."""
    for name, value in (("MEMBERS", members), ("SHARD", shard), ("CROWN", crown)):
        monkeypatch.setattr(trie, name, value)
    rows = conversations(members, 40)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    df = df.selectExpr("*", "1 AS n1", "2 AS turns", "3 AS depth", "4 AS shard")
    assert trie_rows(trie.prefix_trie(df)) == plain_trie(rows)


def test_trie_of_an_empty_table_and_of_nobody(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert trie.prefix_trie(df).count() == 0 and trie.prefix_trie(df.filter("turn = 2")).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(c, 0, "user", "only turn")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert trie_rows(trie.prefix_trie(df)) == plain_trie(rows) == [(c, 0, None, 1, 0, 1, 0, sha(str(c).encode()))]


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 62), 1 << 62, (2, 20_000))
    keys[0, :5000] = 7  # digests that share one half
    known = trie.NodeTable(keys[0], keys[1])
    slots = known.slots(keys[0], keys[1])
    assert sorted(slots.tolist()) == list(range(20_000))
    assert (known.slots(keys[1], keys[0]) == trie.NO_SLOT).all()
    assert len(trie.NodeTable(keys[0, :0], keys[1, :0]).slots(keys[0, :3], keys[1, :3])) == 3
    with pytest.raises(ValueError):
        trie.NodeTable(np.array([1, 1]), np.array([2, 2]))


def test_crown_members_are_hashed_piece_by_piece(spark):
    rows = [(1, 2, c) for c in range(5000, 0, -1)] + [(1, 3, 7), (0, 0, 9)]
    got = {(r["n1"], r["n2"]): r["ends_sha256"] for r in trie._crown_ends(spark.createDataFrame(rows, "n1 bigint, n2 bigint, conv_id bigint").repartition(6)).collect()}
    want = {(1, 2): ",".join(map(str, range(1, 5001))), (1, 3): "7", (0, 0): "9"}
    assert got == {k: sha(v.encode()) for k, v in want.items()}


# --- collocations -----------------------------------------------------------------------


def plain_collocations(rows, least, longest, top):
    out = []
    named = lambda own: "und" if own is None else own
    for lang in sorted({named(r[0]) for r in rows}):
        f = Counter()
        for own, text in rows:
            if named(own) == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
                    words = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in candidates.items():
            if not any(len(q) > len(p) and c >= a and inside(p, q) for q, c in candidates.items()):
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def collocation_texts(seed):
    rnd = random.Random(seed)
    names = ["aa", "Bb", "cc", "dd", "é", "the", "the", "x-y", "z\x1f", "'", "Q"]
    rows = []
    for i in range(60):
        text = "".join(rnd.choice(names) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ".", "! "]) for _ in range(rnd.randrange(60)))
        rows.append((rnd.choice(["en", "en", "en", "de", None, ""]), text + "new york city hall new york"))
    return rows + [("en", None), ("en", ""), (None, " \t., "), ("en", rows[0][1]), ("en", rows[0][1]), ("de", "big word " * 9000 + ". small. " + "é" * 200)]


@pytest.mark.parametrize("seed,least,longest,flush,limit,heavy,top", [
    (1, 5, 5, 1 << 21, 1 << 20, 1 << 16, 50), (2, 3, 5, 40, 200, 2, 7), (3, 4, 3, 100, 50, 10, 2000), (4, 10**6, 5, 100, 1 << 20, 4, 5), (5, 2, 2, 7, 30, 3, 1000)])
def test_collocations_against_brute_force(spark, monkeypatch, seed, least, longest, flush, limit, heavy, top):
    """Small buffers, cut rows and cut stripes give the same result."""
    rows = collocation_texts(seed)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4).selectExpr("*", "1 AS n", "2 AS key", "3 AS code", "'x' AS word")
    made = {"FLUSH": flush, "LIMIT": limit, "HEAVY": heavy}
    for name, value in made.items():
        monkeypatch.setattr(collocations, name, value)
    got = collocations.mine_collocations(df, least, longest, top).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_collocations(rows, least, longest, top))


def test_stripes_with_small_buffers():
    """The functions that run in tasks, with limits that workers of a session do not see."""
    rows = collocation_texts(9)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows], pa.string())], ["lang", "text"])
    bits = np.full(4096, 255, np.uint8)
    none = np.zeros(0, np.uint64)
    want = None
    for flush, limit, cut in ((1 << 21, 1 << 20, 0), (13, 64, 0), (50, 1000, 3)):
        collocations.FLUSH, collocations.LIMIT = flush, limit
        try:
            prefixes = np.unique(np.concatenate([collocations._begin(c, lang) for lang, c, *_ in collocations._coded([batch], none)]))
            heavy = (prefixes, np.full(len(prefixes), cut)) if cut else (none, none)
            parts = list(collocations._stripe_maker(1, bits, heavy, none, 7)([batch.slice(0, 20), batch.slice(20)]))
        finally:
            collocations.FLUSH, collocations.LIMIT = 1 << 21, 1 << 20
        stripes = pa.Table.from_batches(parts).sort_by("shard")
        merged = list(collocations._merger(1, 1)(stripes.to_batches(max_chunksize=5)))
        got = Counter({(lang, p[0], w): n for b in merged for lang, p, ws, ns, _ in zip(*(c.to_pylist() for c in b.columns)) for w, n in zip(ws, ns)})
        want = want or got
        assert got == want and sum(got.values()) > 1000


def test_words_of_one_code_get_others(spark, monkeypatch):
    """With codes of few values, frequent words clash; the counter gives up their codes."""
    rows = [("en", "a b c d e f g h " * 10), ("en", "a b")]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 2), pa.array([t for _, t in rows])], ["lang", "text"])
    real = collocations.range_hashes
    monkeypatch.setattr(collocations, "range_hashes", lambda *a: real(*a) & np.uint64(3))
    counted = pa.Table.from_batches(collocations._word_counter(np.zeros(0, np.uint64))([batch]))
    assert sum(counted.column("n").to_pylist()) == 82 and len(set(counted.column("word").to_pylist())) == 8
    again = pa.Table.from_batches(collocations._word_counter(np.arange(4, dtype=np.uint64))([batch]))
    assert len(set(again.column("code").to_pylist())) == 8
    assert dict(zip(again.column("word").to_pylist(), again.column("n").to_pylist()))[b"a"] == 11


def test_collocations_of_an_empty_table(spark):
    df = spark.createDataFrame([("en", "a b")], "lang string, text string")
    assert collocations.mine_collocations(df.filter("lang = 'x'")).count() == 0
    assert collocations.mine_collocations(df).count() == 0


def test_large_products_stay_exact(spark):
    """Scores are whole quotients of products beyond 64 bits."""
    from pyspark.sql import functions as F

    a, n, left, right = 10**13 + 7, 10**15 + 3, 10**13 + 9, 2 * 10**13 + 1
    score = spark.range(1).select(F.lit(a).alias("a"), F.lit(n).alias("n"), F.lit(left).alias("l"), F.lit(right).alias("r")).select(collocations.quotient().alias("s"))
    assert score.first()["s"] == 1000 * a * n // (left * right)
    assert hashlib.sha256(b"").hexdigest() == trie._EMPTY
