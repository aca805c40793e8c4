"""One query per operator, over its whole table with production parameters, and SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclabel.llm import bpe, collocations, decontaminate, licenses, lines, mixing, neardup, pages, quality, repeats, rules, tokens, trie
from doclabel.llm.common import with_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_key(table(spark, sf_dir, "documents"), "_key", "text")
    found = repeats.remove_repeats(keyed, "_key")
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        (F.size("spans") / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    matched, names = decontaminate.match_benchmark(docs, table(spark, sf_dir, "benchmark"))
    n_hit, contaminated = decontaminate.judge(matched, names)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return matched.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), contaminated.alias("contaminated"))


@register
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.default_templates(spark))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id", "n_words", F.size(names).cast("bigint").alias("n_licenses"), F.array_join(names, ",").alias("licenses"),
        F.size("matches").cast("bigint").alias("n_windows"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"))


@register
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, scorer)
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


@register
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_quality(table(spark, sf_dir, "documents"))


@register
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(table(spark, sf_dir, "pages"))


@register
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@register
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_key(table(spark, sf_dir, "documents"), "_key", "text")
    return neardup.near_duplicates(keyed, "_key").select("doc_id", "n_shingles", "component_id", "kept")


@register
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@register
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


@register
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN), vocabulary)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# --- SQL --------------------------------------------------------------------------------

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op1_suffix_array_dedup"] = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, p, hash(h[2 * p + 1 : 2 * p + 200]) AS a, hash('x' || h[2 * p + 1 : 2 * p + 200]) AS b
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g
  FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, g, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM s),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(h[2 * before + 1 : 2 * a] || CASE WHEN back = 1 THEN h[2 * b + 1 :] ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""

ORACLES["op2_benchmark_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), {_WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), {_WORDS}) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

ORACLES["op3_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || md5(doc_id::VARCHAR || ':mix-1')[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
r AS (SELECT source, z, 2.0::DOUBLE * z AS cap, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM r),
l AS (
  SELECT *, (1.5::DOUBLE * sum(z) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
v AS (SELECT min_by(level, k) AS level FROM l WHERE cap > level * w),
t AS (SELECT source, z, CASE WHEN v.level IS NULL OR cap <= v.level * w THEN cap ELSE v.level * w END AS target FROM o, v)
SELECT doc_id, size, z AS source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken
FROM (SELECT d.*, t.z, t.target, CASE WHEN t.z > 0 THEN t.target / t.z ELSE 0.0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)"""

def _template_rows() -> str:
    """The templates with the shingle size, window width and stride that their words give."""
    rows = []
    for name, text in licenses.TEMPLATES.items():
        words = len(re.findall(r"[0-9A-Za-z]+", text))
        size = min(licenses.SHINGLE, words)
        width, stride = licenses.window_of(words - size + 1)
        rows.append(f"('{name}', '{text}', {size}, {width}, {stride})")
    return ", ".join(rows)


ORACLES["op4_license_scans"] = rf"""
WITH t(license, text, size, width, stride) AS (VALUES {_template_rows()}),
tw AS (SELECT *, regexp_extract_all(translate(text, {_UP}, {_LOW}), {_WORDS}) AS w FROM t),
tg AS (SELECT DISTINCT license, size, width, stride, array_to_string(w[i : i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM tw)),
tn AS (SELECT license, count(*) AS n FROM tg GROUP BY license),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), {_WORDS}) AS w FROM documents),
dg AS (SELECT doc_id, size, i - 1 AS i, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM t) WHERE len(w) >= size)),
h AS (SELECT doc_id, license, i, g, width, stride FROM dg JOIN tg USING (g, size)),
x AS (SELECT doc_id, license, g, unnest(range(greatest(0, (i - width + stride) // stride), i // stride + 1)) AS k FROM h),
c AS (SELECT doc_id, license, k, count(DISTINCT g) AS m FROM x GROUP BY 1, 2, 3),
m AS (SELECT doc_id, license, m::DOUBLE / n AS c FROM c JOIN tn USING (license) WHERE 100 * m >= 75 * n),
r AS (SELECT doc_id, count(DISTINCT license) AS n_licenses, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, count(*) AS n_windows, max(c) AS containment FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses,
  coalesce(n_windows, 0)::BIGINT AS n_windows, coalesce(containment, 0.0)::DOUBLE AS containment FROM d LEFT JOIN r USING (doc_id)"""

ORACLES["op9_line_dedup"] = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_UP}, {_LOW}) AS k FROM l),
f AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (k) GROUP BY doc_id"""

ORACLES["op10_minhash_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') || ' ' ELSE array_to_string(w[i : i + 4], ' ') END) AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v WHERE r.root < e.b),
c AS (SELECT v, min(root) AS component_id FROM r GROUP BY v)
SELECT c.v AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = c.v AS kept FROM c LEFT JOIN n ON n.doc_id = c.v"""

# crc32 bit by bit: the remainder of the digits' bits by the fixed polynomial.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))))"""

ORACLES["op11_conversation_prefix_trie"] = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t USING (conv_id) WHERE t.p > c.h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS depth, length(role) || ':' || length(text) || ':' || role || text AS turn,
    len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM r),
o AS MATERIALIZED (SELECT conv_id, depth, string_agg(turn, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS key, words FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS MATERIALIZED (SELECT key, depth, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(words) AS words FROM o GROUP BY key, depth),
p AS (SELECT n.key, n.depth, u.conv_id AS parent_conv_id, u.key AS parent_key FROM n LEFT JOIN o ON o.conv_id = n.conv_id AND o.depth = n.depth - 1 LEFT JOIN n u ON u.key = o.key AND u.depth = o.depth),
k AS MATERIALIZED (SELECT n.*, parent_conv_id, coalesce(n_children, 0)::BIGINT AS n_children FROM n JOIN p USING (key, depth)
  LEFT JOIN (SELECT parent_key AS key, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL) USING (key, depth)),
s AS (SELECT a.key, a.depth, sum((k.n_children = 0)::INT)::BIGINT AS n_leaves, sum((k.n_convs - 1) * k.words)::BIGINT AS saved_tokens
  FROM k JOIN o a ON a.conv_id = k.conv_id AND a.depth <= k.depth GROUP BY ALL),
e AS (SELECT key, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(depth) AS depth FROM o GROUP BY conv_id) JOIN o USING (conv_id, depth) GROUP BY ALL)
SELECT k.conv_id, k.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM k JOIN s USING (key, depth) LEFT JOIN e USING (key, depth)"""

ORACLES["op12_phrase_collocations"] = rf"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_UP}, {_LOW}), '[.,;:!?
-
]')) AS piece FROM documents)),
g AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, g, f, string_split(g, ' ') AS w FROM g WHERE m >= 2 AND f >= 100),
x AS (SELECT DISTINCT s.lang, s.g FROM c s JOIN c y ON y.lang = s.lang AND y.m > s.m AND 100 * y.f >= 100 * s.f AND contains(' ' || y.g || ' ', ' ' || s.g || ' ')),
k AS (SELECT lang, g, m, f AS a, w, unnest(range(1, m)) AS k FROM c ANTI JOIN x USING (lang, g)),
s AS (SELECT k.lang, k.g, k.a, k.k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.m = k AND l.g = array_to_string(w[1:k], ' ') JOIN g r ON r.lang = k.lang AND r.m = k.m - k AND r.g = array_to_string(w[k + 1 :], ' ') JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM b
QUALIFY rank <= 2000"""
