"""Prefix trie of conversations: a node table behind a minimal perfect hash, shard by shard.

Turns are digested where they are read, so no text is shuffled.  A conversation's rows pass one task in order, which
chains their digests: row ``d`` names the node of the first ``d`` turns.  Counting the names gives the nodes with their members,
pre-aggregated before the shuffle, so a prefix that a third of all conversations share is one row a task.

What a subtree sums up has to meet in one place.  Nodes with more than ``limit`` members are the trie's *top*; the limit
follows the number of rows, so the top has at most ``TOP_NODES`` nodes besides the root at any size.  Every other node hangs below exactly one
subtree whose root has a parent in the top, and these subtrees, of at most ``limit`` members each, are dealt to shards.
In a shard

* a minimal perfect hash (levels of bit vectors with ranks) gives every node digest a slot of its own,
* a parent's slot is looked up and verified against the digest in the table, since the hash sends strangers to any slot,
* counts are scattered into flat arrays by slot, and children, leaves and saved tokens are added up through the array of
  parent slots, deepest nodes first.

The subtrees' sums are added per parent and the top takes the same function as one last shard.

Defined cases: a null role or text is empty; turns of a null ``conv_id`` belong to no conversation and are left out; rows of equal
turn are in order of role, then of the text's first ``HEAD`` characters, then of their digest (equal rows stay and
count as turns each); a conversation without turns ends at the root; an empty table has no node; other columns are not read.
A task holds the nodes of at least one conversation (some 100 bytes a turn), however long that is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.core import idiv

from .common import Scratch, limit_batches

FAMILY = 100  # conversations that share the opening turns of the first of them
MAX_SHARED = 5  # most turns that are taken over
HEAD = 64
TOP_NODES = 100_000
LEAST_LIMIT = 256
SHARD_NODES = 200_000
ID_BLOCK = 1 << 16  # conversation ids that are joined into one piece of text

NODE = "a long, b long"
PATHS = "conv_id long, depth int, a long, b long, pa long, pb long, chars long, is_end boolean"
RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string"
)
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers


# --- minimal perfect hash -------------------------------------------------------------------------------------------


def _positions(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each digest among the ``size`` of a level."""
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(_MIX[0] * (2 * level + 1) & (1 << 64) - 1)) * np.uint64(_MIX[1])
        x ^= x >> np.uint64(32)
        x = (x + b) * np.uint64(_MIX[0])
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n-1 for ``n`` distinct digests (two unsigned 64-bit words each).

    A level has two places a key; keys alone at their place are settled there, the others go on to the next level.  A
    key's slot is the rank of its place among all settled places, so every slot is used once.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, before = np.arange(len(a)), 0
        while len(rest):
            if len(self.levels) == 200:
                raise ValueError("digests are not distinct")
            size = 2 * len(rest)
            at = _positions(a[rest], b[rest], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            settled = np.zeros(size, bool)
            settled[at[alone]] = True
            self.levels.append((settled, before + np.cumsum(settled) - 1))
            before += int(alone.sum())
            rest = rest[~alone]

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest; for one that is not in the table any slot, or -1."""
        out, rest = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (settled, rank) in enumerate(self.levels):
            at = _positions(a[rest], b[rest], level, len(settled))
            here = settled[at]
            out[rest[here]] = rank[at[here]]
            rest = rest[~here]
        return out


def accumulate(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Children, leaves and saved tokens of the nodes of a shard, and each node's parent.

    ``nodes``: digest ``a, b``, its parent's ``pa, pb``, ``depth``, ``n_convs``, ``chars``, ``conv_id``, and what comes
    from nodes elsewhere: ``children``, ``leaves``, ``saved``.  The results are in slot order, as is ``order``, the rows of the slots.
    """
    word = lambda name: nodes[name].astype(np.int64).view(np.uint64)
    a, b = word("a"), word("b")
    table = PerfectHash(a, b)
    slot = table.slots(a, b)
    order = np.empty(len(a), np.int64)
    order[slot] = np.arange(len(a))
    a, b, pa_, pb_ = a[order], b[order], word("pa")[order], word("pb")[order]
    parent = table.slots(pa_, pb_)
    depth = nodes["depth"][order]
    known = (parent >= 0) & (a[parent] == pa_) & (b[parent] == pb_) & (depth > 0)
    parent[~known] = -1
    children, leaves, saved = (nodes[x][order].astype(np.int64) for x in ("children", "leaves", "saved"))
    children += np.bincount(parent[known], minlength=len(a))
    saved += (nodes["n_convs"][order] - 1) * nodes["chars"][order]
    leaves[children == 0] = 1
    by_depth = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in np.split(by_depth, cuts):
        up = level[known[level]]
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])
    return {"order": order, "parent": parent, "children": children, "leaves": leaves, "saved": saved}


# --- rebuilding and naming -------------------------------------------------------------------------------------------


def shared_turns(conv_id="conv_id"):
    """Turns that a conversation takes over from the first of its family: crc32 of its decimal id, mod 6."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % (MAX_SHARED + 1)).cast("int")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, chars)``: each conversation's turns in order, from 1, with a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, HEAD).alias("head"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    ).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "digest")
    return turns.select("conv_id", F.row_number().over(order).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv_id, part, pos, digest, chars)``: a row without digest opens every conversation, then come the turns taken
    over from the family's first conversation (part 1) and its own after as many (part 2)."""
    named = turns.withColumns({"h": shared_turns(), "family": F.col("conv_id") - F.col("conv_id") % FAMILY})
    convs = named.filter("pos = 1")
    opening = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    first = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= MAX_SHARED)).withColumnRenamed("conv_id", "family")
    taken = convs.filter("conv_id != family").select("conv_id", "family", "h").join(first, "family").filter("pos <= h")
    own = named.filter("pos > h or conv_id = family")
    row = lambda df, part: df.select("conv_id", F.lit(part).alias("part"), "pos", "digest", "chars")
    return opening.unionByName(row(taken, 1)).unionByName(row(own, 2))


def paths_of(rows: DataFrame) -> DataFrame:
    """``PATHS``: the nodes on each conversation's path, the root included.  A task reads whole conversations in order
    and keeps one digest."""
    limit_batches(rows.sparkSession)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "digest", "chars")
    names = [x.split()[0] for x in PATHS.split(", ")]
    kinds = {"conv_id": pa.int64(), "depth": pa.int32(), "is_end": pa.bool_()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None  # of a row, all but is_end, which the next row tells
        node = b""
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}

            def put(row: list, is_end: bool, out=out) -> None:
                for n, x in zip(names, [*row, is_end]):
                    out[n].append(x)

            for conv, digest, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None:
                    put(last, conv != last[0])
                if digest is None:
                    node = bytes(16)
                    last = [conv, 0, 0, 0, None, None, 0]
                else:
                    node = hashlib.blake2b(node + digest, digest_size=16).digest()
                    a, b = int.from_bytes(node[:8], "big", signed=True), int.from_bytes(node[8:], "big", signed=True)
                    last = [conv, last[1] + 1, a, b, last[2], last[3], chars]
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pydict({n: [x] for n, x in zip(names, [*last, True])}, schema=schema)

    return ordered.mapInArrow(run, PATHS)


def counted_nodes(paths: DataFrame) -> DataFrame:
    """One row a node.  Rows of one digest have to agree in all that they say of the node, else two nodes collide."""
    same = ["depth", "pa", "pb", "chars"]
    found = paths.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        *[F.min(c).alias(c) for c in same],
        *[F.max(c).alias(f"{c}_max") for c in same],
    )
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.col(f"{c}_max"))
    checked = F.when(agree, F.lit(True)).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("boolean"))
    return found.filter(checked).drop(*[f"{c}_max" for c in same])


def end_digests(paths: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)`` of the nodes at which conversations end: SHA-256 of their ids, ascending, comma-joined.
    Ids are joined in blocks of ``ID_BLOCK`` values, so a task sorts and joins a bounded number, and a node's blocks are
    hashed one after the other."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    blocks = (
        paths.filter("is_end")
        .groupBy("a", "b", idiv(F.col("conv_id"), F.lit(ID_BLOCK)).alias("block"))
        .agg(F.array_join(ids, ",").alias("ids"))
    )
    ordered = blocks.repartition("a", "b").sortWithinPartitions("a", "b", "block").select("a", "b", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) == node:
                    state.update(b"," + text.encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(text.encode())
            yield _ends(out)
        if node:
            yield _ends([(*node, state.hexdigest())])

    return ordered.mapInArrow(run, "a long, b long, ends_sha256 string")


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["a", "b", "ends_sha256"])


# --- the trie --------------------------------------------------------------------------------------------------------

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_SHARD = f"{RESULT}, top_a long, top_b long"


def _summed(shards: DataFrame) -> DataFrame:
    """``RESULT`` of the nodes of each value of ``shard``; ``top_a, top_b`` name the parent of those whose parent is elsewhere."""

    def shard(table: pa.Table) -> pa.Table:
        flat = {c: table.column(c).fill_null(0).to_numpy() for c in ("a", "b", "pa", "pb", "conv_id", "depth", "n_convs", "chars", "children", "leaves", "saved")}
        s = accumulate(flat)
        order, parent = s["order"], s["parent"]
        inside = parent >= 0
        conv = flat["conv_id"][order]
        above = table.column("top_conv").take(pa.array(order)).combine_chunks()
        parent_conv = pa.array(np.where(inside, conv[parent], above.fill_null(0).to_numpy(zero_copy_only=False)), mask=~inside & above.is_null().to_numpy(zero_copy_only=False))
        outside = inside | (flat["depth"][order] == 0)
        columns = [conv, flat["depth"][order].astype(np.int64), parent_conv, flat["n_convs"][order], s["children"], s["leaves"], s["saved"], table.column("ends_sha256").take(pa.array(order)).combine_chunks()]
        columns += [pa.array(flat[x][order], mask=outside) for x in ("pa", "pb")]
        return pa.table(columns, names=[x.split()[0] for x in _SHARD.split(", ")])

    return shards.groupBy("shard").applyInArrow(shard, _SHARD)


def prefix_trie(conversations: DataFrame, limit: int | None = None, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Per node of the trie of rebuilt conversations: ``RESULT``.  ``limit``: most members of a subtree that a shard takes
    whole (default: from the number of rows)."""
    spark = conversations.sparkSession
    scratch = Scratch(spark)
    turns = scratch.cut(numbered_turns(conversations))
    paths = scratch.cut(paths_of(rebuilt(turns)))
    nodes = counted_nodes(paths).join(end_digests(paths), ["a", "b"], "left").fillna(_EMPTY_SHA, ["ends_sha256"])
    nodes = scratch.cut(nodes)
    if limit is None:
        limit = max(LEAST_LIMIT, math.ceil(paths.count() / TOP_NODES))
    # A row of paths is a member of one node, so at most paths / limit nodes have more than limit members.
    in_top = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    top = nodes.filter(in_top)
    known = F.broadcast(top.select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("conv_id").alias("top_conv")))
    on = lambda x, y: (F.col(x) == F.col("ta")) & (F.col(y) == F.col("tb"))

    # Where each conversation's path leaves the top; a node's least member tells its subtree.
    left = paths.join(known, on("pa", "pb")).drop("ta", "tb", "top_conv").join(known, on("a", "b"), "left_anti")
    left = left.select("conv_id", F.xxhash64("a", "b").alias("subtree"))
    light = nodes.filter(~in_top).join(left, "conv_id").join(known, on("pa", "pb"), "left").drop("ta", "tb")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nodes.count() / shard_nodes))
    zero = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    below = scratch.cut(_summed(light.withColumns({"shard": F.pmod("subtree", F.lit(shards)), **zero})))

    sums = below.filter("top_a is not null").groupBy(F.col("top_a").alias("a"), F.col("top_b").alias("b")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    upper = top.join(sums, ["a", "b"], "left").withColumns({"shard": F.lit(0).cast("long"), "top_conv": F.lit(None).cast("long")})
    return below.unionByName(_summed(upper)).drop("top_a", "top_b")
