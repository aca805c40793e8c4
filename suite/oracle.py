"""SQL (DuckDB dialect) for the tables the checks share, composed on demand."""

from __future__ import annotations

import re

from doclabel.functions.text import BRACKET_MATH, DASHES_APOSTROPHES, DOLLAR_MATH
from doclabel.sources.label_bank import TWO_CHARACTER_CLASSES
from suite.fixtures import CODES_SQL, LEXICON_TAG_SQL, TAG_SQL


# White space spelled out by code point, independently of the engine's patterns.
WHITESPACE = (
    r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
NON_ALPHAS = f"[^a-zA-Z{WHITESPACE}]+"
SPACES = f"[{WHITESPACE}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, '{by}', 'g')"


def math_free(expr: str) -> str:
    return sub(sub(expr, DOLLAR_MATH, " "), BRACKET_MATH, " ")


def alphas(expr: str) -> str:
    return f"replace({sub(sub(expr, DASHES_APOSTROPHES, ' '), NON_ALPHAS, '')}, chr(10), ' ')"


def split_words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {quoted(SPACES)}), lambda x: x <> '')"


def clean_words(expr: str) -> str:
    return split_words(alphas(math_free(expr)))


def fbeta(beta: float, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    w = float(beta * beta)
    return f"CASE WHEN (1 + {w}) * {tp} + {w} * {fn} + {fp} > 0 THEN (1 + {w}) * {tp} / ((1 + {w}) * {tp} + {w} * {fn} + {fp}) ELSE 0.0 END"


def suitable(min_freq: int = 4) -> str:
    return (
        f"freq >= {min_freq} AND ((tag IN ('NNP','NN','NNS','JJ') AND length(word) >= 4) "
        "OR (tag = 'NNP' AND length(word) >= 3))"
    )


def vocab_sql(tagged: str, tag_filter: str = "true") -> str:
    """Vocabulary over a table of tagged words."""
    return f"""SELECT word AS key, arg_max(tag, spot) AS tag, arg_max(freq, spot) AS freq,
      row_number() OVER (ORDER BY min(spot)) - 1 AS id
      FROM (SELECT word, tag, count(*) AS freq, min(paper_id * 10000000 + pos) AS spot FROM {tagged}
            WHERE {tag_filter} GROUP BY word, tag) WHERE {suitable()} GROUP BY word"""


def selection_sql(words: str, vocab: str) -> str:
    """Words and phrases in the vocabulary per document, one row each, ordered by p."""
    return f"""SELECT c.paper_id, c.p, c.key, v.id FROM (
        SELECT paper_id, 2 * pos AS p, word AS key FROM (SELECT *, lead(word) OVER (PARTITION BY paper_id ORDER BY pos) AS nxt FROM {words}) WHERE nxt IS NOT NULL
        UNION ALL
        SELECT paper_id, 2 * pos + 1, word || '_' || nxt FROM (SELECT *, lead(word) OVER (PARTITION BY paper_id ORDER BY pos) AS nxt FROM {words}) WHERE nxt IS NOT NULL
      ) c JOIN {vocab} v ON c.key = v.key"""


def tokens_sql(source: str, ident: str, words: str) -> str:
    return f"SELECT {ident}, unnest({words}) AS word, unnest(range(len({words}))) AS pos FROM {source}"


BANK_VALUES = ", ".join(
    f"({quoted(key)}, {number}, {quoted(name)})" for number, (key, name) in enumerate(TWO_CHARACTER_CLASSES)
)

MI_SQL = """SELECT *, CASE WHEN n1 > 0 AND n1 < total AND n2 > 0 AND n2 < total AND freq > 0 AND n1 > freq AND n2 > freq AND total - n1 - n2 + freq > 0 THEN
   (total - n1 - n2 + freq) / total * log2(((total - n1 - n2 + freq) / total) / ((1 - n1 / total) * (1 - n2 / total)))
   + (n2 - freq) / total * log2(((n2 - freq) / total) / ((1 - n1 / total) * (n2 / total)))
   + (n1 - freq) / total * log2(((n1 - freq) / total) / ((n1 / total) * (1 - n2 / total)))
   + freq / total * log2((freq / total) / ((n1 / total) * (n2 / total)))
   ELSE 0.0 END AS mutual_info FROM pairs_marg"""

# name -> SQL; references to other names are found and resolved.
TABLES = {
    "bank": f"SELECT * FROM (VALUES {BANK_VALUES}) AS t(key, id, description)",
    "papers": f"""SELECT doc_id AS paper_id, text AS "Abstract", {CODES_SQL} AS "MSCs" FROM documents""",
    "words": f"""SELECT paper_id, "MSCs", {clean_words('"Abstract"')} AS w FROM papers""",
    "raw_words": f"""SELECT doc_id AS paper_id, lang, {split_words('text')} AS w FROM documents""",
    "tok": tokens_sql("words", 'paper_id', "w"),
    "raw_tok": tokens_sql("raw_words", "paper_id, lang", "w"),
    "tagged": f"SELECT paper_id, pos, word, {TAG_SQL} AS tag FROM tok",
    "vocab": vocab_sql("tagged"),
    "lexicon": f"SELECT word, {LEXICON_TAG_SQL} AS tag FROM (SELECT DISTINCT unnest({clean_words('text')}) AS word FROM benchmark)",
    # phrases
    "stream": """SELECT paper_id, pos, v.id, row_number() OVER (ORDER BY paper_id, pos) AS rn
      FROM tok JOIN vocab v ON tok.word = v.key
      WHERE (paper_id, pos) <> (SELECT (paper_id, pos) FROM tok ORDER BY paper_id DESC, pos DESC LIMIT 1)""",
    "pairs": """SELECT id1, id2, count(*) AS freq FROM (
      SELECT id AS id1, lead(id) OVER (ORDER BY rn) AS id2 FROM stream) WHERE id2 IS NOT NULL GROUP BY id1, id2""",
    "firsts": "SELECT id1 AS id, sum(freq) AS n FROM pairs GROUP BY id1",
    "pairs_marg": """SELECT p.id1, p.id2, v1.key AS w1, v2.key AS w2, v1.tag AS tag1, v2.tag AS tag2, p.freq,
      f1.n::DOUBLE AS n1, coalesce(f2.n, 0)::DOUBLE AS n2, (SELECT sum(freq) FROM pairs)::DOUBLE AS total
      FROM pairs p JOIN vocab v1 ON p.id1 = v1.id JOIN vocab v2 ON p.id2 = v2.id
      JOIN firsts f1 ON f1.id = p.id1 LEFT JOIN firsts f2 ON f2.id = p.id2""",
    "scored_pairs": MI_SQL,
    "phrases": """SELECT w1, w2, row_number() OVER (ORDER BY w1, w2) - 1 AS id, tag1, tag2, mutual_info, freq FROM (
      SELECT * FROM scored_pairs WHERE mutual_info > 0
      ORDER BY round(mutual_info, 9) DESC, w1, w2 LIMIT (SELECT floor(0.7 * count(*))::BIGINT FROM vocab))""",
    "full_vocab": """SELECT key, id, tag, freq FROM vocab UNION ALL
      SELECT w1 || '_' || w2, id + (SELECT count(*) FROM vocab), tag1 || ',' || tag2, freq FROM phrases""",
    "codes": """SELECT paper_id, pos, code FROM (
      SELECT paper_id, substr(code, 1, 2) AS code, min(pos) AS pos FROM (
        SELECT paper_id, unnest(string_split("MSCs", '|')) AS code, unnest(range(len(string_split("MSCs", '|')))) AS pos FROM papers
      ) GROUP BY paper_id, substr(code, 1, 2)) WHERE code IN (SELECT key FROM bank)""",
    "selected": selection_sql("tok", "vocab"),
    "full_selected": selection_sql("tok", "full_vocab"),
    "processed": """SELECT paper_id FROM codes WHERE paper_id IN
      (SELECT paper_id FROM full_selected GROUP BY paper_id HAVING count(*) >= 10) GROUP BY paper_id""",
    "ptok": "SELECT s.* FROM full_selected s JOIN processed USING (paper_id)",
    "pcodes": "SELECT c.*, b.id AS label_id FROM codes c JOIN processed USING (paper_id) JOIN bank b ON b.key = c.code",
    # tf-idf over classes
    "cells": "SELECT t.id, c.label_id AS label, count(*) AS n FROM ptok t JOIN pcodes c USING (paper_id) GROUP BY t.id, c.label_id",
    "tfidf_parts": """SELECT v.key, v.id, v.tag, coalesce(doc_freq, 0) AS doc_freq,
      CASE WHEN doc_freq > 0 THEN ln(1 + (SELECT count(DISTINCT label_id) FROM pcodes) / doc_freq) ELSE 0.0 END AS idf,
      coalesce(tf_sum, 0.0) AS tf_sum
      FROM full_vocab v LEFT JOIN (
        SELECT id, count(*) AS doc_freq, sum(n / peak) AS tf_sum FROM cells
        JOIN (SELECT label, max(n) AS peak FROM cells GROUP BY label) USING (label) GROUP BY id) w ON w.id = v.id""",
    "tfidf_words": """SELECT key, id, tag, idf, 0.5 * (tf_sum - (SELECT min(tf_sum) FROM tfidf_parts)) * idf AS tfidf FROM tfidf_parts""",
    # information gain over languages
    "raw_selected": selection_sql("raw_tok", "vocab"),
    "lang_cells": "SELECT s.id, d.lang AS label, count(*) AS n FROM raw_selected s JOIN documents d ON d.doc_id = s.paper_id GROUP BY s.id, d.lang",
    "prior": """SELECT lang AS label, count(*) AS n_docs,
      (count(*) + 1) / ((SELECT count(*) FROM documents) + (SELECT count(DISTINCT lang) FROM documents)) AS p_label
      FROM documents GROUP BY lang""",
    "word_probs": """SELECT v.key, v.id, p.label, p.p_label, coalesce(c.n, 0) AS n,
      (sum(coalesce(c.n, 0)) OVER (PARTITION BY v.id) + (SELECT count(*) FROM prior))
        / ((SELECT sum(n) FROM lang_cells) + (SELECT count(*) FROM vocab) * (SELECT count(*) FROM prior)) AS p_word,
      (coalesce(c.n, 0) + 1) / (sum(coalesce(c.n, 0)) OVER (PARTITION BY p.label) + (SELECT count(*) FROM vocab)) AS p_word_label
      FROM vocab v CROSS JOIN prior p LEFT JOIN lang_cells c ON c.id = v.id AND c.label = p.label""",
    "posterior": "SELECT key, id, label, p_word_label * p_label / p_word AS p_label_word FROM word_probs",
    # splits
    "ranked": "SELECT *, row_number() OVER (ORDER BY paper_id) - 1 AS rk, count(*) OVER () AS n FROM processed",
    "split8020": "SELECT paper_id, rk, n, CASE WHEN rk < floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM ranked",
    # unigram model on the processed papers
    "uni_cells": "SELECT c.label_id, t.id AS word_id, t.key, count(*) AS n FROM ptok t JOIN pcodes c USING (paper_id) GROUP BY ALL",
    "uni_cells_train": """SELECT c.label_id, t.id AS word_id, t.key, count(*) AS n FROM ptok t JOIN pcodes c USING (paper_id)
      JOIN split8020 s USING (paper_id) WHERE s.split = 'train' GROUP BY ALL""",
    # scores
    "score_cells": """SELECT vec_id, label, c, x / sum(x) OVER (PARTITION BY vec_id) AS p,
      CASE WHEN c = label OR (vec_id % 4 = 0 AND c = (label + 3) % 10) THEN 1 ELSE 0 END AS y
      FROM (SELECT vec_id, any_value(label) AS label, i % 10 AS c, sum(exp(5 * x)) AS x FROM (
        SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id, i % 10)""",
    "score_best": "SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS place FROM score_cells",
    "word_vectors": """SELECT key AS word, list_transform(range(8), lambda k: (((id * 31 + k * 17) % 101) / 101.0)::FLOAT) AS vector
      FROM vocab WHERE id % 5 <> 0""",
    "vec_keys": "SELECT word AS key, 0 AS id FROM word_vectors",
    "vec_selected": selection_sql("raw_tok", "vec_keys"),
    "shuffled": "SELECT doc_id AS paper_id, row_number() OVER (ORDER BY md5(doc_id || ':73'), doc_id) - 1 AS position FROM documents",
    "samples": """SELECT paper_id, y, CASE WHEN rk < n - n * 10 // 100 THEN 'train' ELSE 'test' END AS split FROM (
      SELECT c.paper_id, b.id AS y, row_number() OVER (ORDER BY md5(c.paper_id || ':73'), c.paper_id) - 1 AS rk, count(*) OVER () AS n
      FROM (SELECT paper_id, arg_min(code, pos) AS code FROM codes GROUP BY paper_id) c JOIN bank b ON b.key = c.code)""",
    "bench_keys": f"""SELECT word AS key, row_number() OVER (ORDER BY min(item_id * 10000000 + pos)) - 1 AS place
      FROM ({tokens_sql(f"(SELECT item_id, {clean_words('text')} AS w FROM benchmark)", 'item_id', 'w')}) GROUP BY word""",
    "records": f"""SELECT 'math/' || lpad(doc_id::VARCHAR, 7, '0') AS "arXiv_id", 'On ' || lang || ' ' || source AS "Title",
      'Author' || (doc_id % 97) || ',' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END
        || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '|Coauthor' || (doc_id % 89) || ',' || source END AS "Authors",
      (DATE '2010-01-01' + (doc_id % 3000)::INTEGER)::DATE::VARCHAR AS "Date", {CODES_SQL} AS "MSCs", text AS "Abstract" FROM documents""",
}


def drawn_sql(selected: str, n: int, seed: int) -> str:
    """``n`` words per document drawn with replacement from its selected words."""
    return f"""SELECT paper_id, k, ws[(('0x' || substr(md5(paper_id || ':' || k || ':{seed}'), 1, 8))::BIGINT % len(ws)) + 1] AS word
      FROM (SELECT paper_id, list(key ORDER BY p) AS ws FROM {selected} GROUP BY paper_id) CROSS JOIN (SELECT unnest(range({n})) AS k)"""


def class_scores_sql(cells: str, docs: str, tokens: str, mode: str) -> str:
    """Class probabilities ``(paper_id, label_id, p)`` for every document and class."""
    value = "(s + m) / (n_c + v)" if mode == "linear" else "s - m * ln(n_c + v)"
    gain = "n" if mode == "linear" else "ln(n + 1)"
    raw = f"""SELECT d.paper_id, b.id AS label_id, coalesce(s.s, 0) AS s, coalesce(m.m, 0) AS m, coalesce(t.n_c, 0) AS n_c,
        (SELECT count(*) FROM full_vocab) AS v
      FROM {docs} d CROSS JOIN bank b
      LEFT JOIN (SELECT t.paper_id, c.label_id, sum({gain}) AS s FROM {tokens} t JOIN {cells} c ON c.word_id = t.id GROUP BY t.paper_id, c.label_id) s
        ON s.paper_id = d.paper_id AND s.label_id = b.id
      LEFT JOIN (SELECT paper_id, count(*) AS m FROM {tokens} GROUP BY paper_id) m ON m.paper_id = d.paper_id
      LEFT JOIN (SELECT label_id, sum(n) AS n_c FROM {cells} GROUP BY label_id) t ON t.label_id = b.id"""
    if mode == "linear":
        return f"SELECT paper_id, label_id, x / nullif(sum(x) OVER (PARTITION BY paper_id), 0) AS p FROM (SELECT paper_id, label_id, {value} AS x FROM ({raw}))"
    return f"""SELECT paper_id, label_id, exp(x - top) / sum(exp(x - top)) OVER (PARTITION BY paper_id) AS p FROM (
      SELECT paper_id, label_id, x, max(x) OVER (PARTITION BY paper_id) AS top FROM (SELECT paper_id, label_id, {value} AS x FROM ({raw})))"""


TABLES["uni_scores"] = class_scores_sql("uni_cells", "processed", "ptok", "linear")
TABLES["uni_scores_log"] = class_scores_sql("uni_cells", "processed", "ptok", "log")
TABLES["split_test"] = "SELECT paper_id FROM split8020 WHERE split = 'test'"
TABLES["ptok_test"] = "SELECT t.* FROM ptok t JOIN split_test USING (paper_id)"
TABLES["uni_scores_test"] = class_scores_sql("uni_cells_train", "split_test", "ptok_test", "linear")

def refresh() -> None:
    """Take tables added since into account."""
    global _NAMES
    _NAMES = re.compile(r"\b(" + "|".join(sorted(TABLES, key=len, reverse=True)) + r")\b")


refresh()


def _needed(sql: str, found: list[str]) -> None:
    for name in dict.fromkeys(_NAMES.findall(re.sub(r"'[^']*'", "''", sql))):
        if name not in found:
            _needed(TABLES[name], found)
            if name not in found:
                found.append(name)


def sql(text: str) -> str:
    """Put the shared tables that ``text`` mentions in front of it."""
    names: list[str] = []
    _needed(text, names)
    if not names:
        return text
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in names) + "\n" + text
