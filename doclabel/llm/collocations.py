"""Collocations: frequent phrases and how much stronger they are than their parts, by stripes.

A prefix of one to four words keys a stripe, the counter of the words that follow
it. Tasks build stripes of what they have read and merge them elementwise after a
shuffle by prefix; the merged table has the extensions of every prefix (phrases
one word longer), their maximum (which tells what a longer phrase subsumes), and,
a level below, the prefix's own total. A level is built only of phrases whose
first and last words were frequent on the level before. Stripes of very frequent
prefixes are dealt in segments of next words.

Words are told apart by 64-bit codes, checked against the words themselves; two
words of one code, if ever there are any, get codes of another hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclabel.llm.common import flat_bytes, mix, range_hashes, row_groups, word_spans, word_table
from doclabel.operators.lookup import lookup_join
from doclabel.session import ship_package
from doclabel.staging import stage

BREAKS = b".,;:!?\n\x0b\x0c\r"
_INSIDE, _LOW = word_table(b" \t" + BREAKS)
_IS_BREAK = np.isin(np.arange(256), list(BREAKS))
LIMIT = 1 << 20
# Words that a task holds before it counts them; bits of the frequent-phrase filter; the most prefixes whose stripes are cut, and the least occurrences of one.
FLUSH, MAX_BITS, MAX_HEAVY, HEAVY = 1 << 21, 1 << 29, 1 << 18, 1 << 16
# Occurrences that are merged together.
SHARD = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- words of a batch -------------------------------------------------------------------


def _row_pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row numbers) of about LIMIT bytes; a longer row is cut behind separators between pieces."""
    for start, end in row_groups(offsets, LIMIT):
        low, high = int(offsets[start]), int(offsets[end])
        if high - low <= LIMIT:
            yield data[low:high], offsets[start : end + 1] - low, np.arange(start, end)
            continue
        cuts = low + 1 + np.flatnonzero(_IS_BREAK[data[low:high]])
        while low < high:
            at = int(np.searchsorted(cuts, low + LIMIT, side="right"))
            if at and cuts[at - 1] > low:
                stop = int(cuts[at - 1])
            else:  # a piece longer than LIMIT stays whole
                stop = int(cuts[at]) if at < len(cuts) else high
            stop = high if high - low <= LIMIT else stop
            yield data[low:stop], np.array([0, stop - low]), np.array([start])
            low = stop


def _codes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    codes = range_hashes(low, starts, ends)
    if len(clashing):
        for i in np.flatnonzero(np.isin(codes, clashing)):
            codes[i] = np.frombuffer(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return codes


def _coded(batches: Iterator[pa.RecordBatch], clashing: np.ndarray):
    """(lang, codes, whether a piece begins at the word, lower-cased bytes, starts, ends) by group of rows and language."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, of_row = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        data, offsets = flat_bytes(batch.column(1))
        for part, offs, rows in _row_pieces(data, offsets):
            starts, ends, bounds = word_spans(part, offs, _INSIDE)
            if not len(starts):
                continue
            low = _LOW[part]
            codes = _codes(low, starts, ends, clashing)
            passed = np.append(0, np.cumsum(_IS_BREAK[part]))
            new = np.ones(len(starts), bool)
            new[1:] = passed[starts[1:]] != passed[ends[:-1]]
            new[bounds[:-1][bounds[:-1] < len(starts)]] = True
            lang = np.repeat(of_row[rows], np.diff(bounds))
            for k in np.unique(lang):
                own = lang == k
                yield names[k], codes[own], new[own], low, starts[own], ends[own]


def _word_counter(clashing: np.ndarray):
    """(lang, code, word, n) of what a task has read; words are combined several times on the way."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def combined(lang: str):
            codes, n, words = zip(*held[lang])
            # Words and not codes alone are told apart: two words of one code both come out.
            grouped = pa.table({"c": np.concatenate(codes), "w": pa.concat_arrays(words), "n": np.concatenate(n)}).group_by(["c", "w"]).aggregate([("n", "sum")])
            return grouped.column("c").to_numpy(), grouped.column("n_sum").to_numpy(), grouped.column("w").combine_chunks()

        def flush():
            for lang in held:
                codes, n, words = combined(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), words, pa.array(n)], ["lang", "code", "word", "n"])

        for lang, codes, _, low, starts, ends in _coded(batches, clashing):
            values, first, inverse, n = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
            raw = low.tobytes()
            words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            lengths = ends - starts
            if (lengths != lengths[first][inverse]).any() or _unlike(low, starts, starts[first][inverse], lengths):
                every = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                values, n, words = codes, np.ones(len(codes), np.int64), every
            held.setdefault(lang, []).append((values, n.astype(np.int64), pa.array(words, pa.binary())))
            size += len(values)
            if size > FLUSH:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return count


def _unlike(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether any of the ranges of ``lengths`` bytes from ``a`` and from ``b`` differ."""
    other = a != b
    a, b, lengths = a[other], b[other], lengths[other]
    total = int(lengths.sum())
    if not total:
        return False
    at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return bool((data[np.repeat(a, lengths) + at] != data[np.repeat(b, lengths) + at]).any())


# --- stripes ----------------------------------------------------------------------------


def _language(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.sha256(lang.encode()).digest()[:8], np.uint64)[0]


def _begin(codes: np.ndarray, lang: str) -> np.ndarray:
    """Hash of each one-word phrase."""
    return mix(codes ^ _language(lang))


def _extend(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of phrases with one more word each."""
    return mix(hashes * _ODD + codes)


def _stripe_maker(level: int, bits: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], clashing: np.ndarray, shards: int):
    """Stripes of prefixes of ``level`` words whose hash, like that of the words from the second on, passes the filter.

    The stripes of a shard that a task has counted at a time are packed in one row.
    """

    def passes(hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(8 * len(bits) - 1)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def stripes(lang: str, codes: np.ndarray, new: np.ndarray) -> pa.RecordBatch | None:
        n = len(codes) - level
        if n <= 0:
            return None
        hashes = _begin(codes, lang)
        for k in range(1, level):
            hashes = _extend(hashes[: len(codes) - k], codes[k:])
        frequent, pieces = passes(hashes), np.cumsum(new)
        at = np.flatnonzero(frequent[:n] & frequent[1 : n + 1] & (pieces[level:] == pieces[:n]))
        if not len(at):
            return None
        whole = _extend(hashes[at], codes[at + level])
        order = np.argsort(whole)
        where = at[order]
        same = whole[order][1:] == whole[order][:-1]
        unlike = np.zeros(len(same), bool)
        for k in range(level + 1):
            unlike |= codes[where[1:] + k] != codes[where[:-1] + k]
        if (same & unlike).any():  # two phrases of one hash: sort by the words
            order = np.lexsort([codes[at + k] for k in range(level + 1)])
            where = at[order]
            unlike = np.any([codes[where[1:] + k] != codes[where[:-1] + k] for k in range(level + 1)], axis=0)
        first = np.flatnonzero(np.append(True, unlike))
        counts, where = np.diff(np.append(first, len(where))), where[first]
        prefix, following = hashes[where], codes[where + level]
        cut = np.zeros(len(where), np.uint64)
        if len(heavy[0]):
            near = np.minimum(np.searchsorted(heavy[0], prefix), len(heavy[0]) - 1)
            cut = np.where(heavy[0][near] == prefix, heavy[1][near], 0).astype(np.uint64)
        # The upper bits of a word's code choose its segment: the same one in every task.
        segment = np.where(cut > 0, following >> (np.uint64(64) - np.maximum(cut, np.uint64(1))), np.uint64(0)).astype(np.int64)
        shard = mix(prefix + segment.astype(np.uint64) * _ODD) % np.uint64(shards)
        order = np.lexsort((segment, prefix, shard))
        where, prefix, following, counts, segment, shard = (c[order] for c in (where, prefix, following, counts, segment, shard))
        edge = (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1])
        for k in range(level):
            edge |= codes[where[1:] + k] != codes[where[:-1] + k]
        first = np.flatnonzero(np.append(True, edge))
        own = np.stack([codes[where[first] + k] for k in range(level)], axis=1).ravel()
        rows = np.flatnonzero(np.append(True, shard[first][1:] != shard[first][:-1]))  # by stripe
        by_stripe, by_entry = np.append(rows, len(first)), np.append(first[rows], len(where))
        as_lists = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int64)))
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(rows), pa.string()), pa.array(shard[first[rows]].astype(np.int64)),
            as_lists(prefix[first], by_stripe), as_lists(own, by_stripe * level), as_lists(np.diff(np.append(first, len(where))), by_stripe),
            as_lists(following, by_entry), as_lists(counts, by_entry),
        ], ["lang", "shard", "h", "prefix", "sizes", "nexts", "counts"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for lang, codes, new, *_ in _coded(batches, clashing):
            held.setdefault(lang, []).append((codes, new))
            size += len(codes)
            if size >= FLUSH:
                yield from _made(held)
                held, size = {}, 0
        yield from _made(held)

    def _made(held):
        for lang, parts in held.items():
            out = stripes(lang, np.concatenate([c for c, _ in parts]), np.concatenate([b for _, b in parts]))
            if out is not None:
                yield out

    return make


_STRIPE = "lang string, shard bigint, h array<bigint>, prefix array<bigint>, sizes array<bigint>, nexts array<bigint>, counts array<bigint>"
_MERGED = "lang string, prefix array<bigint>, nexts array<bigint>, counts array<bigint>, hashes array<bigint>"


def _merge(table: pa.Table, level: int, least: int) -> pa.RecordBatch | None:
    """Add stripes of the same prefix elementwise and keep the words that follow it ``least`` times or more."""
    flat = {c: table.column(c).combine_chunks() for c in ("h", "prefix", "sizes", "nexts", "counts")}
    lang = table.column("lang").combine_chunks().dictionary_encode()
    of_lang = np.repeat(lang.indices.to_numpy(), np.diff(flat["h"].offsets.to_numpy()))  # by stripe, as the next two
    h = flat["h"].flatten().to_numpy().view(np.uint64)
    prefix = flat["prefix"].flatten().to_numpy().reshape(-1, level)
    row = np.repeat(np.arange(len(h)), flat["sizes"].flatten().to_numpy())
    following, counts = flat["nexts"].flatten().to_numpy(), flat["counts"].flatten().to_numpy()
    by_hash = np.argsort(h, kind="stable")
    alike = h[by_hash][1:] == h[by_hash][:-1]
    other = (of_lang[by_hash][1:] != of_lang[by_hash][:-1]) | (prefix[by_hash][1:] != prefix[by_hash][:-1]).any(axis=1)
    if (alike & other).any():  # prefixes of one hash
        order = np.lexsort((following, *prefix[row].T, of_lang[row]))
    else:
        order = np.lexsort((following, h[row]))
    row, following = row[order], following[order]
    stripe = np.append(True, (of_lang[row][1:] != of_lang[row][:-1]) | (prefix[row][1:] != prefix[row][:-1]).any(axis=1))
    first = np.flatnonzero(stripe | np.append(True, following[1:] != following[:-1]))
    sums = np.add.reduceat(counts[order], first)
    frequent = sums >= least
    if not frequent.any():
        return None
    number = np.cumsum(stripe)[first][frequent]
    row, following, sums = row[first][frequent], following[first][frequent], sums[frequent]
    starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    offsets = pa.array(np.append(starts, len(number)), pa.int32())
    rows = row[starts]
    hashes = _extend(h[row], following.view(np.uint64))
    return pa.RecordBatch.from_arrays([
        lang.dictionary.take(pa.array(of_lang[rows])),
        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * level, pa.int32()), pa.array(prefix[rows].ravel())),
        *[pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (following, sums, hashes.view(np.int64))],
    ], ["lang", "prefix", "nexts", "counts", "hashes"])


def _merger(level: int, least: int):
    """Merged stripes of rows sorted by shard; a shard is merged once its last row has come."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column(1).to_numpy()
            borders = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
            for start, end in zip(borders, [*borders[1:], len(shard)]):
                if held and held[-1].column(1)[-1].as_py() != shard[start]:
                    if (out := _merge(pa.Table.from_batches(held), level, least)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(start, end - start))
        if held and (out := _merge(pa.Table.from_batches(held), level, least)) is not None:
            yield out

    return merge


# --- from level to level ----------------------------------------------------------------


def _bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    """A filter that lets all ``n`` hashes pass, and few others unless they are very many: MAX_BITS at most."""
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(15, (16 * n).bit_length()))
    at = hashes.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at"))
    blocks = at.groupBy(F.floor(F.col("at") / 32768).alias("block")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bytes"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in blocks.collect():  # at most MAX_BITS bits
        out[r["block"]] = np.frombuffer(r["bytes"], np.uint8)
    return out.ravel()


def count_words(docs: DataFrame, least: int) -> tuple[DataFrame, np.ndarray]:
    """(lang, code, word, n) of all words, stored; and the codes that had to be given up because two words had them."""
    clashing = np.zeros(0, np.uint64)
    while True:
        counted = docs.mapInArrow(_word_counter(clashing), "lang string, code bigint, word binary, n bigint")
        words = stage(counted.groupBy("lang", "code", "word").agg(F.sum("n").alias("n")), "words")
        shared = words.groupBy("lang", "code").agg(F.count("*").alias("words"), F.sum("n").alias("n")).filter((F.col("words") > 1) & (F.col("n") >= least))
        found = [r["code"] for r in shared.select("code").distinct().collect()]  # frequent words of one 64-bit hash: hardly ever any
        if not found:
            return words, clashing
        clashing = np.append(clashing, np.array(found, np.int64).view(np.uint64))


def phrase_stripes(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """All words (lang, code, word, n) and the merged stripes of (lang, text) rows.

    A row of the stripe table is a prefix of codes with the words that follow it
    ``least`` times or more; a very frequent prefix has several rows, one per segment.
    """
    spark = docs.sparkSession
    words, clashing = count_words(docs, least)
    frequent = words.filter(F.col("n") >= least)
    known = stage(frequent.select("lang", "code", F.col("n").alias("f")).mapInArrow(_first_hashes, "h bigint, f bigint"), "frequent")
    tables = []
    for level in range(1, longest):
        count, total = known.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
        if not count:
            break
        # Prefixes with at least this many occurrences are MAX_HEAVY at most, by their sum.
        bound = max(HEAVY, -(-total // MAX_HEAVY))
        heavy = known.filter(F.col("f") >= bound).select("h", F.ceil(F.log2(F.col("f") / bound)).cast("bigint").alias("cut")).orderBy("h").toArrow()
        parts = heavy.column("h").to_numpy().view(np.uint64), np.minimum(heavy.column("cut").to_numpy() + 1, 32)
        order = np.argsort(parts[0])
        sent = spark.sparkContext.broadcast((_bitmap(known, count), (parts[0][order], parts[1][order])))
        # As many shards as keep the occurrences of each within SHARD, and some for every partition.
        shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
        made = docs.mapInArrow(_lazily(level, sent, clashing, shards), _STRIPE)
        dealt = made.repartition("shard").sortWithinPartitions("shard")
        merged = stage(dealt.mapInArrow(_merger(level, least), _MERGED), f"stripes-{level}")
        tables.append(merged)
        known = merged.select(F.explode(F.arrays_zip(F.col("hashes").alias("h"), F.col("counts").alias("f"))).alias("x")).select("x.*")
    stripes = tables[0] if tables else spark.createDataFrame([], _MERGED)
    for t in tables[1:]:
        stripes = stripes.unionByName(t)
    return words, stripes


def _lazily(level: int, sent, clashing: np.ndarray, shards: int):
    """The stripe maker, built from the broadcast where it runs."""
    return lambda batches: _stripe_maker(level, *sent.value, clashing, shards)(batches)


def _first_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column(1).to_numpy().view(np.uint64)
        langs = batch.column(0).dictionary_encode()
        seeds = np.array([_language(x) for x in langs.dictionary.to_pylist()], np.uint64)
        hashes = mix(codes ^ seeds[langs.indices.to_numpy()]) if len(codes) else codes
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(2)], ["h", "f"])


def quotient() -> Column:
    """floor(1000 a n / (l r)) by exact division of 38-digit products."""
    exact = lambda c: f"cast({c} AS decimal(19, 0))"
    return F.expr(f"(cast(1000 AS decimal(4, 0)) * cast({exact('a')} * {exact('n')} AS decimal(34, 0))) div ({exact('l')} * {exact('r')})")


def mine_collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has ``lang`` and ``text``. Texts are lower-cased (A-Z) and split at
    ``. , ; : ! ?`` and line ends into pieces, these at spaces and tabs into words.
    A candidate is a phrase of 2 to ``longest`` words found ``least`` times or more,
    not across pieces. Of its cuts in two, found l and r times, the one with the
    least floor(1000 a n / (l r)) counts, n being the words of the language. A
    candidate that is part of a longer one found as often is left out. The first
    ``top`` of each language by score, a, both descending, and phrase are returned.

    Null text: no words. Null lang: ``und``. Repeated rows count each; ids are not
    used. An empty table gives an empty result. Other columns are ignored, whatever
    their names. Counts are exact, at any size.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text"))
    words, stripes = phrase_stripes(texts, least, longest)
    totals = stage(words.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    words = words.filter(F.col("n") >= least)
    key = lambda codes: F.struct(F.col("lang").alias("lang"), codes.alias("codes"))
    longer = stripes.select("lang", "prefix", F.explode(F.arrays_zip(F.col("nexts").alias("next"), F.col("counts").alias("f"))).alias("x"))
    phrases = longer.select("lang", F.concat("prefix", F.array("x.next")).alias("codes"), F.col("x.f").alias("f"))
    found = stage(words.select(key(F.array("code")).alias("key"), F.col("n").alias("f")).unionByName(phrases.select(key(F.col("codes")).alias("key"), "f")), "phrases")

    # The most frequent phrase that is one word longer, to the right (a stripe's maximum) or to the left.
    right = stripes.select(key(F.col("prefix")).alias("key"), F.array_max("counts").alias("longer"))
    left = phrases.select(key(F.slice("codes", F.lit(2), F.size("codes") - 1)).alias("key"), F.col("f").alias("longer"))
    longest_f = right.unionByName(left).groupBy("key").agg(F.max("longer").alias("longer"))
    candidates = found.filter(F.size("key.codes") >= 2).join(longest_f, "key", "left").filter(F.coalesce("longer", F.lit(0)) < F.col("f"))
    cuts = candidates.select(F.col("key").alias("own"), F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("key.codes") - 1)).alias("k"))
    part = lambda start, length: F.struct(F.col("own.lang").alias("lang"), F.slice("own.codes", start, length).alias("codes"))
    cuts = lookup_join(cuts.withColumn("key", part(F.lit(1), F.col("k"))), found.withColumnRenamed("f", "l"), "key").drop("key")
    cuts = lookup_join(cuts.withColumn("key", part(F.col("k") + 1, F.size("own.codes") - F.col("k"))), found.withColumnRenamed("f", "r"), "key").drop("key")
    cuts = lookup_join(cuts.withColumn("lang", F.col("own.lang")), totals, "lang")
    best = cuts.groupBy("own", "a", "n").agg(F.min(F.struct(quotient().alias("score"), "k", "l", "r")).alias("cut"))
    rows = best.select(F.col("own.lang").alias("lang"), F.col("own.codes").alias("codes"), "a", "cut.l", "cut.r", "n", "cut.score")
    strongest = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    chosen = stage(rows.withColumn("place", F.rank().over(strongest)).filter(F.col("place") <= top), "strongest")
    spelled = lookup_join(
        chosen.select(F.struct("lang", "codes").alias("id"), F.posexplode("codes").alias("pos", "code")).withColumn("key", F.struct("id.lang", "code")),
        words.select(F.struct("lang", "code").alias("key"), F.col("word").cast("string").alias("word")), "key")
    names = spelled.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    named = chosen.withColumn("id", F.struct("lang", "codes")).join(names, "id")
    ordered = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(ordered).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
