"""Near-duplicate documents by min-max hashing, confirmed on whole shingle sets.

Each permutation of the shingles gives two signature values, the least and the
greatest hash, so that one hash evaluation serves two. Equal sets are one class
from the start; class representatives that share a band are candidates. A band's
bucket is never unfolded into pairs: its first member is compared with all
others. Buckets which that leaves in several components are compared block by
block, each member's set sent once per bucket, and only where sizes and rare
shingles leave a link possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclabel.llm.common import flat_bytes, fresh, hashed_words, mix, row_groups, with_key, word_table
from doclabel.session import ship_package
from doclabel.staging import stage

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4  # 64 permutations; a pair at 0.75 shares no band with a chance of about 5 in a million
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 2_000_000  # members of a bucket, and their shingles, that are compared as one block
GROUP_BYTES, BLOCK = 1 << 20, 1 << 14
_INSIDE, _LOW = word_table(b" \t\n\x0b\x0c\r")
_DEALT = pa.schema([
    ("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("key", pa.int64()), ("root", pa.int64()),
    ("n", pa.int64()), ("high", pa.int64()), ("opened", pa.binary()), ("shingles", pa.binary())])
_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, i, 1 << 64)) for i in range(64)]


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; fewer words make one shingle, no word an empty set."""
    data, offsets = flat_bytes(texts)
    for a, b in row_groups(offsets, GROUP_BYTES):
        low = offsets[a]
        words, bounds = hashed_words(data[low : offsets[b]], offsets[a : b + 1] - low, _INSIDE, _LOW)
        n = max(len(words) - size + 1, 0)
        grams = np.zeros(n, np.uint64)
        for i in range(size):
            grams += words[i : i + n] * _POWERS[i]
        grams = mix(grams)
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if y - x >= size:
                yield np.unique(grams[x : y - size + 1])
            elif y > x:
                short = sum((int(w) * int(p) for w, p in zip(words[x:y], _POWERS)), y - x)
                yield mix(np.array([short % (1 << 64)], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            else:
                yield np.zeros(0, np.uint64)


class MinMax:
    """Bands of min-max signatures: ``bands`` times ``rows`` values from half as many permutations."""

    def __init__(self, bands: int, rows: int):
        if bands * rows % 2:
            raise ValueError("bands * rows must be even")
        self.bands, self.rows = bands, rows
        seeds = mix(np.arange(1, bands * rows // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.factor, self.shift = (seeds | np.uint64(1))[:, None], mix(seeds)[:, None]
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        self.turn = np.array(_POWERS[:rows], np.uint64)

    def buckets(self, shingles: np.ndarray) -> np.ndarray:
        """One bucket id per band. A band's values come from different permutations."""
        least, most = [], []
        for at in range(0, len(shingles), BLOCK):
            hashes = shingles[None, at : at + BLOCK] * self.factor
            hashes += self.shift
            hashes ^= hashes >> np.uint64(32)
            hashes *= np.uint64(0xD6E8FEB86659FD93)
            least.append(hashes.min(1))
            most.append(hashes.max(1))
        values = np.concatenate([np.min(least, 0), np.max(most, 0)]).reshape(self.bands, self.rows)
        return mix((mix(values) * self.turn).sum(1, dtype=np.uint64) ^ self.salt)


def signatures(keyed: DataFrame, key: str, size: int, bands: int, rows: int) -> DataFrame:
    """Per document: key, doc_id, set size, 128 bits that name the set, and the bucket of every band."""
    schema = f"`{key}` bigint, doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint, buckets array<bigint>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = MinMax(bands, rows)
        for batch in batches:
            sizes, c1, c2, found = [], [], [], []
            for s in shingle_sets(batch.column(2), size):
                sizes.append(len(s))
                # Sums over distinct elements, each spread by a bijection, name the set.
                c1.append(int(mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)))
                c2.append(int(mix(s + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)))
                found.append(scheme.buckets(s).astype(np.int64) if len(s) else [])
            whole = lambda x: pa.array(np.array(x, np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), whole(c1), whole(c2), pa.array(found, pa.list_(pa.int64()))], [key, "doc_id", "n_shingles", "c1", "c2", "buckets"])

    return keyed.select(F.col(key), F.col("doc_id").cast("bigint"), "text").mapInArrow(sign, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach ``percent``; ``texts`` is (key, text)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader = None, None
        for batch in batches:
            keys, good = batch.column(0).to_pylist(), []
            new = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            leaders = dict(zip(new, shingle_sets(batch.column(2).take(pa.array(new)), size)))
            for i, other in enumerate(shingle_sets(batch.column(3), size)):
                if i in leaders:
                    last, leader = keys[i], leaders[i]
                assert last == keys[i]
                both = len(np.intersect1d(leader, other, assume_unique=True))
                good.append(100 * both >= percent * (len(leader) + len(other) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root the smallest node of its component.

    Alternating large and small stars: edges are rewired to the least neighbour
    until every component is one star. Each step is a minimum per node and a
    join on narrow rows, written to the shared folder.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a")
        edges = stage(small.select("a", F.col("m").alias("b")).unionAll(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        got = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if (got["n"], got["s"]) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (got["n"], got["s"])


def _rooted(rows: DataFrame, on: str, roots: DataFrame | None) -> DataFrame:
    """``rows`` with the component of ``on``, itself if it has no link."""
    if roots is None:
        return rows.withColumn("root", F.col(on))
    found = roots.select(F.col("node").alias(on), F.col("root").alias("_root"))
    return rows.join(found, on, "left").withColumn("root", F.coalesce("_root", on)).drop("_root")


def shingle_rows(texts: DataFrame, size: int) -> DataFrame:
    """(shingle, key), one row for each shingle of each text."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            keys = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
            shingles = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            for at in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(shingles[at : at + (1 << 18)]), pa.array(keys[at : at + (1 << 18)])], ["shingle", "key"])

    return texts.select("key", "text").mapInArrow(unfold, "shingle bigint, key bigint")


def partner_limits(texts: DataFrame, sizes: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Limits (key, n, high), and the pairs (a, b) of texts that share a shingle found in at most three of ``texts``.

    A pair outside the second table shares no such rare shingle. If m of n are
    not rare, a partner of size k then has at most m / (n + k - m), so a partner
    of more than ``high`` = m / percent - n + m shingles cannot reach the similarity.
    """
    found = shingle_rows(texts, size).groupBy("shingle").agg(F.count("*").alias("df"), F.min("key").alias("x"), F.max("key").alias("z"), F.bit_xor("key").alias("all"))
    middle = F.when(F.col("df") == 3, F.col("all").bitwiseXOR(F.col("x")).bitwiseXOR(F.col("z")))
    # Texts that share one rare shingle mostly share many: one row per group of texts.
    rare = stage(found.filter("df <= 3").select("df", "x", "z", middle.alias("y")).groupBy("df", "x", "y", "z").agg(F.count("*").alias("n")), "rare")
    own = rare.select(F.col("x").alias("key"), "n").unionAll(rare.filter("df > 1").select("z", "n")).unionAll(rare.filter("df = 3").select("y", "n"))
    shared = F.col("n_shingles") - F.coalesce("r", F.lit(0))
    high = F.floor(shared * 100 / percent) - F.col("n_shingles") + shared
    limits = sizes.join(own.groupBy("key").agg(F.sum("n").alias("r")), "key", "left").select("key", F.col("n_shingles").alias("n"), high.cast("bigint").alias("high"))
    three = rare.filter("df = 3")
    pairs = rare.filter("df > 1").select(F.col("x").alias("a"), F.col("z").alias("b")).unionAll(three.select("x", "y")).unionAll(three.select("y", "z"))
    return limits, pairs.distinct()


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each slice of ``values`` between two offsets; slices may be empty."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def block_links(bucket: int, same: bool, side, keys, roots, n, high, opened, sets, percent: int) -> list[tuple[int, int]]:
    """Links between the components of the members of one block, or of two blocks of a bucket.

    A pair without a common rare shingle can be linked only if each size is at
    most the other's ``high``; then the smaller member's ``high`` is at least its
    own size, so that only such members lead, each against those not smaller. A
    pair that shares a smaller bucket is compared there. Every compared pair is
    compared on its whole sets.
    """
    order = np.lexsort((keys, n))
    side, keys, n, high = side[order], keys[order], n[order], high[order]
    _, group = np.unique(roots[order], return_inverse=True)
    flat = lambda rows: (np.unique(np.concatenate(rows), return_inverse=True)[1], np.r_[0, np.cumsum([len(r) for r in rows])])
    shingle, ends = flat([sets[i] for i in order])
    earlier, stops = flat([opened[i][opened[i] < bucket] for i in order])
    has, shares = np.zeros(len(shingle), bool), np.zeros(len(earlier) + 1, bool)
    links = []
    for x in np.flatnonzero(high >= n).tolist():
        y = np.arange(x + 1, np.searchsorted(n, min(high[x], 100 * n[x] // percent), side="right"))
        y = y[(group[y] != group[x]) & (high[y] >= n[x])]
        y = y if same else y[side[y] != side[x]]
        if not len(y):
            continue
        first, last = y[0], y[-1] + 1
        shares[earlier[stops[x] : stops[x + 1]]] = True
        y = y[_sums(shares[earlier[stops[first] : stops[last]]], stops[first : last + 1] - stops[first])[y - first] == 0]
        shares[earlier[stops[x] : stops[x + 1]]] = False
        if not len(y):
            continue
        first, last = y[0], y[-1] + 1
        has[shingle[ends[x] : ends[x + 1]]] = True
        both = _sums(has[shingle[ends[first] : ends[last]]], ends[first : last + 1] - ends[first])[y - first]
        has[shingle[ends[x] : ends[x + 1]]] = False
        for z in y[100 * both >= percent * (n[x] + n[y] - both)].tolist():
            if group[z] != group[x]:
                links.append((int(keys[x]), int(keys[z])))
                group[group == group[z]] = group[x]
    return links


def compared_blocks(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Members (bucket, key, root, n, high) of buckets to the links (a, b) that join their components.

    A bucket is cut into blocks of bounded size, and a task gets two of them at
    a time. A text is read once; its set goes to the blocks its key is compared in.
    """
    width = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = members.groupBy("bucket").agg(width.alias("blocks"))
    own = F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int")
    of_key = members.join(blocks, "bucket").groupBy("key").agg(
        F.first("root").alias("root"), F.first("n").alias("n"), F.first("high").alias("high"), F.sort_array(F.collect_list(F.struct("bucket", "blocks", own.alias("own")))).alias("places"))
    schema = "bucket bigint, i int, j int, side int, key bigint, root bigint, n bigint, high bigint, opened binary, shingles binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, roots, n, high, places = (batch.column(i).to_pylist() for i in range(1, 6))
            out, held = [], 0
            for r, s in enumerate(shingle_sets(batch.column(0), size)):
                whole = s.tobytes()
                opened = np.array([x["bucket"] for x in places[r]], np.int64).tobytes()
                for x in places[r]:
                    for other in range(x["blocks"]):
                        out.append((x["bucket"], min(x["own"], other), max(x["own"], other), x["own"], keys[r], roots[r], n[r], high[r], opened, whole))
                        held += len(whole)
                        if held >= GROUP_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _DEALT.types)], schema=_DEALT)
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _DEALT.types)], schema=_DEALT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows):
            bucket, i, j = rows[0][:3]
            numbers = [np.array(c, np.int64) for c in list(zip(*rows))[3:8]]
            found = block_links(bucket, i == j, *numbers, [np.frombuffer(r[8], np.int64) for r in rows], [np.frombuffer(r[9], np.uint64) for r in rows], percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        rows = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:3] != rows[0][:3]:
                    yield links(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield links(rows)

    dealt = texts.join(of_key, "key").select("text", "key", "root", "n", "high", "places").mapInArrow(deal, schema)
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(compare, "a bigint, b bigint")


def link_classes(reps: DataFrame, texts_of, size: int, percent: int) -> DataFrame | None:
    """Components (node, root) of class representatives (key, n_shingles, buckets); None without any link.

    ``texts_of(keys)`` gives (key, text) of the candidates. First the least
    member of each bucket is compared with the others. Buckets whose members are
    then of several components are compared in blocks. Pairs that their sizes and
    rare shingles rule out are not compared; every other pair that shares a
    bucket is tested or already connected in the end.
    """
    rows = stage(reps.select("key", F.explode("buckets").alias("bucket")), "bands")
    # Bands of near copies often hold the very same members: one such bucket serves for all.
    heads = (
        rows.groupBy("bucket").agg(F.min("key").alias("head"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("m1"), F.bit_xor(F.xxhash64("key", F.lit("m"))).alias("m2"))
        .filter("n > 1").groupBy("head", "n", "m1", "m2").agg(F.min("bucket").alias("bucket")).select("bucket", "head")
    )
    members = stage(rows.join(heads, "bucket").select("bucket", "key", "head"), "members")
    if members.isEmpty():
        return None
    sizes = stage(reps.join(members.select("key").distinct(), "key", "left_semi").select("key", "n_shingles"), "candidates")
    texts = stage(texts_of(sizes.select("key")), "texts")
    first = members.filter("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()
    for side in ("a", "b"):
        first = first.join(sizes.select(F.col("key").alias(side), F.col("n_shingles").alias(f"n{side}")), side)
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    links = stage(confirmed(stage(first.filter(fits).select("a", "b"), "pairs"), texts, size, percent), "links")
    roots = None if links.isEmpty() else components(links)

    # Roots are looked up once for a candidate; a bucket of one component is done.
    rooted = stage(_rooted(sizes, "key", roots), "rooted")
    placed = stage(members.join(rooted, "key").select("bucket", "key", "root"), "placed")
    several = placed.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("open")).filter("open").select("bucket")
    now = stage(placed.join(several, "bucket", "left_semi"), "open")
    if now.isEmpty():
        return roots
    limits, special = partner_limits(texts.join(now.select("key").distinct(), "key", "left_semi"), sizes, size, percent)
    for side in ("a", "b"):
        special = special.join(rooted.select(F.col("key").alias(side), F.col("root").alias(f"r{side}"), F.col("n_shingles").alias(f"n{side}")), side)
    special = stage(special.filter((F.col("ra") != F.col("rb")) & fits).select("a", "b"), "pairs")
    now = now.join(limits.filter(100 * F.col("high") >= percent * F.col("n")), "key")
    # Only members that may have a partner of their own size lead; a bucket without one holds no further link.
    lead = F.when(F.col("high") >= F.col("n"), F.col("n"))
    least = now.groupBy("bucket").agg(F.min(lead).alias("least"), F.count("*").alias("members")).filter("members > 1 AND least IS NOT NULL")
    now = stage(now.join(least, "bucket").filter(F.col("high") >= F.col("least")).select("bucket", "key", "root", "n", "high"), "now")
    found = stage(compared_blocks(now, texts, size, percent).unionAll(confirmed(special, texts, size, percent)), "links")
    if found.isEmpty():
        return roots
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b")) if roots is not None else None
    return components(found if known is None else found.unionAll(known))


def near_duplicates(keyed: DataFrame, key: str, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``keyed`` (unique long ``key``, doc_id, text): key, doc_id, n_shingles, root, component_id, kept.

    ``root`` is the smallest key reachable over links, ``component_id`` its
    doc_id, and ``kept`` marks the one row of each component that is its root.

    Null or empty texts, and texts without words, have empty sets and stand
    alone. Repeated rows have equal sets and fall into one component, whose first
    key stays. An empty table gives an empty result.
    """
    spark = keyed.sparkSession
    ship_package(spark)
    signed = stage(signatures(keyed, key, size, bands, rows), "signatures")
    classes = stage(signed.filter("n_shingles > 0").groupBy("c1", "c2").agg(F.min(key).alias("rep")), "classes")
    reps = signed.join(classes.select(F.col("rep").alias(key)), key, "left_semi").select(F.col(key).alias("key"), "n_shingles", "buckets")

    def texts_of(keys: DataFrame) -> DataFrame:
        return keyed.select(F.col(key).alias("key"), "text").join(keys, "key", "left_semi")

    roots = link_classes(reps, texts_of, size, percent)
    rooted = _rooted(classes, "rep", roots).select("c1", "c2", "root")
    placed = signed.drop("buckets").join(rooted, ["c1", "c2"], "left").withColumn("root", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col(key)))
    names = signed.select(F.col(key).alias("root"), F.col("doc_id").alias("component_id"))
    return placed.join(names, "root").select(key, "doc_id", "n_shingles", "root", "component_id", (F.col(key) == F.col("root")).alias("kept"))


def dedup_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that are the first of their component.

    Rows without text or words stay. Of repeated rows one stays; rows with null
    ids come last in the order. An empty table gives an empty result. Other
    columns pass unchanged, whatever their names.
    """
    key = fresh(docs, "_key")
    keyed = with_key(docs, key, *[c for c in docs.columns if c != "doc_id"])
    kept = near_duplicates(keyed, key, **options).filter("kept").select(key)
    return keyed.join(kept, key, "left_semi").select(docs.columns)
