"""Prefix trie of conversations in minimal-perfect-hash node tables.

A node is named by a 128-bit digest of the turns that lead to it. Nodes with many
members form the crown, a connected top of the trie whose size is bounded; below
it hang subtrees with few members each, which are dealt whole to shards. A shard
enumerates its distinct digests, gives each a slot by a minimal perfect hash that
is verified against the digest kept in the slot, scatters counts into flat arrays,
and adds them up through the array of parent slots, deepest nodes first. The
crown gets the sums of what hangs below it and is added up in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclabel.llm.common import WORD, mix
from doclabel.session import ship_package
from doclabel.staging import stage

# The most nodes of the crown, the least members of one, and the turns of a shard: they steer the plan only.
CROWN, MEMBERS, SHARD = 1 << 20, 64, 1 << 18
NO_SLOT = -1
_EMPTY = hashlib.sha256(b"").hexdigest()
_OCCURRENCE = "shard int, n1 bigint, n2 bigint, p1 bigint, p2 bigint, depth bigint, words bigint, n bigint, conv_id bigint"
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


class NodeTable:
    """Slots 0 to n - 1 of n distinct 128-bit digests.

    Level by level, keys that are alone at their place get it; the rest goes on to
    the next level. A slot keeps its digest, so a lookup is proven by comparison.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.high, self.low = np.empty_like(high), np.empty_like(low)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, used = np.arange(len(high)), 0
        while len(rest):
            if len(self.levels) == 100:
                raise ValueError("digests must be distinct")
            at = self._places(high[rest], low[rest], len(self.levels), 2 * len(rest) + 1)
            alone = np.bincount(at, minlength=2 * len(rest) + 1) == 1
            slots = np.cumsum(alone) - 1 + used
            placed = alone[at]
            taken = slots[at[placed]]
            self.high[taken], self.low[taken] = high[rest[placed]], low[rest[placed]]
            self.levels.append((alone, slots))
            used += len(taken)
            rest = rest[~placed]

    @staticmethod
    def _places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = mix(np.array([2 * level + 1], np.uint64))[0]
        return (mix(high.view(np.uint64) ^ salt) + low.view(np.uint64)) % np.uint64(size)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of each digest, NO_SLOT for those that are not in the table."""
        out, rest = np.full(len(high), NO_SLOT), np.arange(len(high))
        for level, (alone, slots) in enumerate(self.levels):
            at = self._places(high[rest], low[rest], level, len(alone))
            here = alone[at]
            slot, found = slots[at[here]], rest[here]
            same = (self.high[slot] == high[found]) & (self.low[slot] == low[found])
            out[found[same]] = slot[same]
            rest = rest[~here]
        return out


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together (first column first), and where each run starts in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    new[:1] = True
    return order, np.flatnonzero(new)


def accumulate(parent: np.ndarray, depth: np.ndarray, *sums: np.ndarray) -> None:
    """Add every node's sums to its parent's, deepest nodes first; ``parent`` holds slots or NO_SLOT."""
    order = np.argsort(depth, kind="stable")
    borders = np.flatnonzero(np.diff(depth[order])) + 1
    for level in reversed(np.split(order, borders)):
        level = level[parent[level] != NO_SLOT]
        for s in sums:
            np.add.at(s, parent[level], s[level])


# --- from turns to prefixes -------------------------------------------------------------


def _turn_digest(role: Column, text: Column) -> Column:
    """128 bits that tell (role, text) pairs apart."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)


def rebuilt_conversations(conversations: DataFrame, group: int = 20, head: int = 4) -> DataFrame:
    """(conv_id, turns): every conversation with the first h turns of its group's first one in place of its own.

    h is crc32 of the decimal conv_id modulo ``head``, the group's first one has the
    number conv_id - conv_id % ``group``. A turn is its digest ``d`` and its ``words``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"))
    tied = not turns.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    # Texts go along only if some turns tie, to order these by them.
    tie = [F.col(c) if tied else F.lit(None).cast("string").alias(c) for c in ("role", "text")]
    turn = F.struct("turn", *tie, _turn_digest(F.col("role"), F.col("text")).alias("d"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    lists = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = stage(lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["words"].alias("words"))).alias("turns")), "conversations")
    firsts = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, head - 1).alias("first"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    placed = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", taken).join(firsts, "base", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    start = F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))
    return placed.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chained digests: element d of n1, n2 names the first d turns, element d of words counts those of the d-th turn."""
    for batch in batches:
        ends = (offsets := batch.column(1).offsets.to_numpy())[1:] - offsets[0]
        flat = batch.column(1).flatten()
        digests, words = flat.field("d").to_pylist(), flat.field("words").to_numpy(zero_copy_only=False)
        chain, at = [], 0
        for end in ends:
            state = bytes(16)
            chain.append(state)
            for d in digests[at:end]:
                state = hashlib.sha256(state + d).digest()[:16]
                chain.append(state)
            at = end
        pairs = np.frombuffer(b"".join(chain), "<i8").reshape(-1, 2)
        starts = np.concatenate([[0], ends]) + np.arange(len(ends) + 1)
        all_words = np.insert(words.astype(np.int64), np.concatenate([[0], ends[:-1]]) if len(ends) else [], 0)
        as_list = lambda values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.ascontiguousarray(values)))
        yield pa.RecordBatch.from_arrays([batch.column(0), as_list(pairs[:, 0]), as_list(pairs[:, 1]), as_list(all_words)], ["conv_id", "n1", "n2", "words"])


# --- shards and crown -------------------------------------------------------------------


def _dealer(crown, n_shards: int):
    """Node and end rows of conversations by shard, combined per batch; crown rows have shard -1, end rows n = 0."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = NodeTable(*crown.value)
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy().astype(np.int64)
            starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
            if not len(sizes):
                continue
            n1, n2, words = (batch.column(i).flatten().to_numpy() for i in (1, 2, 3))
            depth = np.arange(len(n1)) - np.repeat(starts, sizes)
            conv = np.repeat(batch.column(0).to_numpy(), sizes)
            light = table.slots(n1, n2) == NO_SLOT
            # Members never grow with depth, so a path's light nodes are all of its nodes from the first one on.
            top = np.minimum(starts + np.add.reduceat(~light, starts), starts + sizes - 1)
            shard = np.where(light, np.repeat((mix(n1[top].view(np.uint64)) % np.uint64(n_shards)).astype(np.int32), sizes), -1)
            p1, p2 = np.roll(n1, 1), np.roll(n2, 1)
            order, first = runs(n1, n2)
            at, last = order[first], starts + sizes - 1
            rows = [np.concatenate([c[at], c[last]]) for c in (shard, n1, n2, p1, p2, depth, words)]
            n = np.concatenate([np.diff(np.append(first, len(order))), np.zeros(len(last), np.int64)])
            least = np.concatenate([np.minimum.reduceat(conv[order], first), conv[last]])
            types = [pa.int32(), *[pa.int64()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*rows, n, least], types)], [c.split()[0] for c in _OCCURRENCE.split(", ")])

    return deal


def _ends(slot: np.ndarray, conv: np.ndarray, n: int) -> list[str]:
    """Per slot the hash of its conv_ids, in order and joined by commas."""
    out = [_EMPTY] * n
    order, first = runs(slot, conv)
    slots, ids = slot[order], conv[order]
    for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(slots)) + 1):
        if len(part):
            out[slots[part[0]]] = hashlib.sha256(",".join(map(str, ids[part].tolist())).encode()).hexdigest()
    return out


def _node_rows(high, low, p1, p2, depth, words, n, conv, more=None, ends=None):
    """The accumulated nodes of one table: columns of _NODE, and the parent slots.

    ``more`` (children, leaves, saved) is what hangs below each row from elsewhere.
    ``ends`` (high, low, conv_id) are the members that end at a node of the table.
    """
    order, first = runs(high, low)
    table = NodeTable(high[order[first]], low[order[first]])
    size, slot = len(first), table.slots(high, low)
    counts, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    np.add.at(counts, slot, n)
    np.minimum.at(least, slot, conv)
    deep, weight, parent = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, NO_SLOT)
    deep[slot], weight[slot] = depth, words
    parent[slot] = np.where(depth > 0, table.slots(p1, p2), NO_SLOT)
    children, leaves, saved = np.zeros((3, size), np.int64)
    if more is not None:
        for total, value in zip((children, leaves, saved), more):
            np.add.at(total, slot, value)
    np.add.at(children, parent[parent != NO_SLOT], 1)
    leaves += children == 0
    saved += (counts - 1) * weight
    accumulate(parent, deep, leaves, saved)
    hashes = None if ends is None else _ends(table.slots(ends[0], ends[1]), ends[2], size)
    parent_conv = pa.array(least[parent], pa.int64(), mask=parent == NO_SLOT)
    return [least, deep, parent_conv, counts, children, leaves, saved, hashes], slot, parent


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _light_nodes(table: pa.Table) -> pa.Table:
    """All nodes of one shard; p1, p2 name the crown node above the top of a subtree."""
    n = table.column("n").to_numpy()
    nodes, ends = table.filter(pa.array(n > 0)), table.filter(pa.array(n == 0))
    high, low, p1, p2, depth, words, n, conv = _columns(nodes, "n1", "n2", "p1", "p2", "depth", "words", "n", "conv_id")
    values, slot, parent = _node_rows(high, low, p1, p2, depth, words, n, conv, ends=_columns(ends, "n1", "n2", "conv_id"))
    above = np.zeros((2, len(parent)), np.int64)
    above[0, slot], above[1, slot] = p1, p2
    inner = (parent != NO_SLOT) | (values[1] == 0)
    arrays = [pa.array(v) for v in values] + [pa.array(a, pa.int64(), mask=inner) for a in above]
    return pa.Table.from_arrays(arrays, [c.split()[0] for c in f"{_NODE}, p1 bigint, p2 bigint".split(", ")])


def _crown_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The crown, one row per node and at most CROWN of them."""
    parts = list(batches)
    if not sum(map(len, parts)):
        return
    table = pa.Table.from_batches(parts)
    high, low, p1, p2, depth, words, n, conv, *more = _columns(table, "n1", "n2", "p1", "p2", "depth", "words", "n", "conv_id", "children", "leaves", "saved")
    values, slot, _ = _node_rows(high, low, p1, p2, depth, words, n, conv, more)
    hashes = np.empty(len(slot), object)
    hashes[slot] = table.column("ends_sha256").to_pylist()
    values[-1] = hashes.tolist()
    yield from pa.Table.from_arrays([pa.array(v) for v in values], [c.split()[0] for c in _NODE.split(", ")]).to_batches()


# --- ends of crown nodes: any number of members -----------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (n1, n2, conv_id) rows to pieces of the joined ids, one for each node and batch."""
    for batch in batches:
        n1, n2, conv = (batch.column(i).to_numpy() for i in range(3))
        new = np.flatnonzero(np.append(True, (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1]))) if len(n1) else np.zeros(0, np.int64)
        texts = [",".join(map(str, part.tolist())) for part in np.split(conv, new[1:])] if len(n1) else []
        yield pa.RecordBatch.from_arrays([pa.array(n1[new]), pa.array(n2[new]), pa.array(conv[new]), pa.array(texts, pa.string())], ["n1", "n2", "least", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each node's pieces, which come in order; one piece is in hand at a time."""
    at, state, done = None, None, []

    def flush():
        rows, done[:] = list(done), []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], ["n1", "n2", "ends_sha256"])

    for batch in batches:
        for n1, n2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if at != (n1, n2):
                if state is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (n1, n2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
        if done:
            yield flush()
    if state is not None:
        done.append((*at, state.hexdigest()))
        yield flush()


def _crown_ends(ends: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256); a node's members may fill many partitions and are joined piece by piece."""
    pieces = ends.repartitionByRange("n1", "n2", "conv_id").sortWithinPartitions("n1", "n2", "conv_id").mapInArrow(_blocks, "n1 bigint, n2 bigint, least bigint, ids string")
    return pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "least").mapInArrow(_hashed, "n1 bigint, n2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, with the sums of its subtree.

    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children,
    n_leaves, saved_tokens, ends_sha256. The root has depth 0 and no parent.

    Null role or text is empty. Turns come in the order of ``turn``, null first;
    turns of one number in the order of role, then text; repeated rows are turns of
    their own. Rows without conv_id belong to no conversation. An empty table has
    no node. Other columns are ignored, whatever their names. A conversation is one
    row of digests, as a text is one value; a prefix may have any number of members.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    chains = rebuilt_conversations(conversations).mapInArrow(_prefixes, "conv_id bigint, n1 array<bigint>, n2 array<bigint>, words array<bigint>")
    chains = stage(chains, "prefixes")
    total = chains.agg(F.coalesce(F.sum(F.size("n1")), F.lit(0))).first()[0]
    # A crown node takes up at least so many of the turns, hence there are at most CROWN of them.
    members = max(MEMBERS, -(-total // CROWN))
    nodes = chains.select(F.explode(F.arrays_zip("n1", "n2")).alias("x")).select("x.*")
    heavy = nodes.groupBy("n1", "n2").agg(F.count("*").alias("n")).filter(F.col("n") >= members).select("n1", "n2").toArrow()
    crown = spark.sparkContext.broadcast(tuple(heavy.column(c).to_numpy().copy() for c in ("n1", "n2")))

    dealt = stage(chains.mapInArrow(_dealer(crown, max(1, total // SHARD)), _OCCURRENCE), "occurrences")
    light = dealt.filter("shard >= 0").groupBy("shard").applyInArrow(_light_nodes, f"{_NODE}, p1 bigint, p2 bigint")
    light = stage(light, "light-nodes")

    top = dealt.filter("shard = -1 AND n > 0").groupBy("n1", "n2").agg(
        *[F.min(c).alias(c) for c in ("p1", "p2", "depth", "words", "conv_id")], F.sum("n").alias("n"))
    hanging = light.filter("p1 IS NOT NULL").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    ends = _crown_ends(dealt.filter("shard = -1 AND n = 0").select("n1", "n2", "conv_id"))
    filled = top.join(hanging, ["n1", "n2"], "left").join(ends, ["n1", "n2"], "left").fillna(0, ["children", "leaves", "saved"]).fillna(_EMPTY, ["ends_sha256"])
    crown_rows = filled.repartition(1).mapInArrow(_crown_nodes, _NODE)  # CROWN rows at most
    names = F.broadcast(stage(top.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("above")), "crown"))
    columns = [c.split()[0] for c in _NODE.split(", ")]
    light_rows = light.join(names, ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*columns)
    return light_rows.unionByName(crown_rows.select(*columns))
