"""SimHash near-duplicates: fingerprints linked by a binary trie self-join, then connected components.

Fingerprints are distinct before anything is joined, so exact copies cost one row.  Two fingerprints that differ in at most
``BITS`` of 64 bits agree on at least two of the six blocks that the bits are cut into, so every linked pair meets in one
of the 15 cells of a pair of blocks.  A cell of more than ``CELL`` fingerprints is cut into chunks and every pair of chunks
becomes a cell of its own.  Within a cell the sorted fingerprints are a binary trie: pairs of nodes are walked together
bit by bit, the differing bits add up, and a pair is dropped as soon as it has more than ``BITS``.  All cells of a slice of
rows are walked at once in numpy.  Found pairs are folded into a spanning forest as they come, so a slice holds a bounded number
of pairs and gives the links of the forest, never all pairs.

Components come from alternating large-star and small-star steps on the links, each cut to the shared folder.

Defined cases: texts without words (null, empty) have the fingerprint zero and are linked like any other; repeated rows and
ids each get a row; a component's id is the least id in it that is not null; an empty table gives no row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_batches, map_texts, texts_of

SHINGLE = 4
BITS = 4
SEED = 42
CELL = 20_000
SLICE = 100_000
FRONTIER = 1 << 20

_EDGES = [0, 11, 22, 33, 44, 54, 64]  # bits of the six blocks, from the highest


def _masks() -> list[int]:
    blocks = [((1 << (64 - a)) - 1) ^ ((1 << (64 - b)) - 1) for a, b in zip(_EDGES, _EDGES[1:])]
    return [x | y for x, y in itertools.combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if over half of the shingles' XXH64 have it; repeats count."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends]
    last = ends[shingle - 1 :] or [len(joined) + 1]
    h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, last)], ">u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long."""

    def compute(ids, texts):
        return {"doc_id": ids, "fp": [signed(fingerprint(t, shingle)) for t in texts]}

    return map_texts(texts_of(docs, id_col, text_col), "doc_id long, fp long", compute)


def trie_pairs(cell: np.ndarray, fp: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell that differ in at most ``bits`` bits, at most ``FRONTIER`` at a time.  Rows are sorted by
    cell, then by fingerprint (unsigned); the rows of a cell are distinct.

    A trie node is a range of rows.  A pair of nodes splits at the next bit into up to four pairs of children; the two
    that take different bits carry one more differing bit.
    """
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    ends = np.append(starts[1:], len(cell))
    grown = ends - starts > 1
    starts, ends = starts[grown], ends[grown]
    ones: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((fp >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        return ones[depth]

    zero = np.zeros(len(starts), np.int64)
    stack = [(0, starts, ends, starts, ends, zero)] if len(starts) else []
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONTIER:  # depth first beyond a bound, so the frontier's memory is bounded
            half = len(a0) // 2
            stack += [(depth, *(x[:half] for x in (a0, a1, b0, b1, diff))), (depth, *(x[half:] for x in (a0, a1, b0, b1, diff)))]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            i, j = i[i != j], j[i != j]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, diff = (x[~single] for x in (a0, a1, b0, b1, diff))
        if not len(a0) or depth == 64:
            continue
        count = ones_before(depth)
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = a0 == b0  # the node with itself: one of its two mixed pairs is enough
        children = [
            (a0, am, b0, bm, diff, ~same | (am - a0 > 1)),
            (am, a1, bm, b1, diff, ~same | (a1 - am > 1)),
            (a0, am, bm, b1, diff + 1, np.ones(len(a0), bool)),
            (am, a1, b0, bm, diff + 1, ~same),
        ]
        kept = [ok & (w < x) & (y < z) & (d <= bits) for w, x, y, z, d, ok in children]
        merged = [np.concatenate([c[k][ok] for c, ok in zip(children, kept)]) for k in range(5)]
        if len(merged[0]):
            stack.append((depth + 1, *merged))


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each node is connected to, by the links ``a``-``b`` and by those that ``label`` already tells."""
    a, b = label[a], label[b]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]


def links(distinct: DataFrame, bits: int = BITS, cell_rows: int = CELL) -> DataFrame:
    """``(u, v)``: links between fingerprints at most ``bits`` apart, a spanning forest of each slice's finds.
    ``distinct``: fp, each once."""
    if not 0 <= bits <= 4:
        raise ValueError("six blocks, two of which agree, hold for at most four differing bits")
    limit_batches(distinct.sparkSession)
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("block")) for k, m in enumerate(_masks())])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.band", "k.block")
    large = rows.groupBy("band", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
    chunks = F.coalesce(F.ceil(F.col("n") / cell_rows), F.lit(1)).cast("int")
    rows = rows.join(large, ["band", "block"], "left").withColumn("chunks", chunks).withColumn("x", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = rows.select("fp", "band", "block", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    key = F.xxhash64("band", "block", "x", "y")
    cells = cells.withColumn("cell", key).select("cell", (F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))).alias("rank"))
    cells = cells.repartition("cell").sortWithinPartitions("cell", "rank")

    def find(cell: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        fp = rank.view(np.uint64) ^ np.uint64(1 << 63)  # in unsigned order, as the rows are
        u, back = np.unique(fp, return_inverse=True)
        root = np.arange(len(u))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in trie_pairs(cell, fp, bits):
            held.append((back[i], back[j]))
            if sum(len(x) for x, _ in held) >= FRONTIER:
                root, held = forest(root, *map(np.concatenate, zip(*held))), []
        if held:
            root = forest(root, *map(np.concatenate, zip(*held)))
        at = np.flatnonzero(root != np.arange(len(u)))
        return pa.RecordBatch.from_arrays([pa.array(u[at].view(np.int64)), pa.array(u[root[at]].view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rank, n = [], [], 0
        for batch in batches:
            cell.append(batch.column(0).to_numpy())
            rank.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= SLICE:
                c, r = np.concatenate(cell), np.concatenate(rank)
                end = int(np.searchsorted(c, c[-1]))  # whole cells only; the last one may go on
                if end:
                    yield find(c[:end], r[:end])
                cell, rank, n = [c[end:]], [r[end:]], len(c) - end
        if n:
            yield find(np.concatenate(cell), np.concatenate(rank))

    return cells.mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """One star step: every neighbour larger (large star) or not larger (small star) than a node is linked to the least of the
    node and these neighbours.  The nodes' least neighbours are written first, so that the join reads two shuffled tables
    and Spark can split a node with very many neighbours over tasks."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    new = scratch.cut(out.filter("u != v").distinct())
    scratch.drop(least)
    return new


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for every node that has a link and is not its component's least."""
    scratch = Scratch(edges.sparkSession)
    state = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s"))
    now = scratch.cut(edges.select("u", "v").distinct())
    mark = now.agg(state).first()[0]
    while mark.n:
        half = _star(now, True, scratch)
        new = _star(half, False, scratch)
        after = new.agg(state).first()[0]
        scratch.drop(now)
        scratch.drop(half)
        now, before, mark = new, mark, after
        if before == mark:
            break
    return now.select("u", F.col("v").alias("root"))


def _placed(distinct: DataFrame, bits: int, cell_rows: int) -> DataFrame:
    """``distinct`` with ``root``, the name of each fingerprint's component."""
    roots = components(links(distinct.select("fp"), bits, cell_rows))
    return distinct.join(roots, distinct.fp == roots.u, "left").withColumn("root", F.coalesce("root", "fp")).drop("u")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, cell_rows: int = CELL
) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits), component_id (least id reachable by links)."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = _placed(distinct, bits, cell_rows)
    # Written, so that the join can split a component of very many fingerprints (see _star).
    named = scratch.cut(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = placed.join(named, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(classes, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def filter_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, cell_rows: int = CELL
) -> DataFrame:
    """One row of each component, with all its columns: that of the least id (nulls last), among those of one id that of the
    least text hash, among equal rows the first written.  Every row is judged by its own text, so an id may
    lose one of its rows and keep another."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.cut(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n")))
    own = rows.select(F.col(f"row.`{id_col}`").cast("long").alias("id"), F.col(f"row.`{text_col}`").cast("string").cast("binary").alias("text"), "n")
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", F.xxhash64("text").alias("hash"), "n").alias("best")

    def mark(best, texts):
        return {"best": best, "fp": [signed(fingerprint(t, shingle)) for t in texts]}

    marked = map_texts(own.select(order, "text"), "best struct<nameless: boolean, id: long, hash: long, n: long>, fp long", mark)
    first = scratch.cut(marked.groupBy("fp").agg(F.min("best").alias("best")))
    kept = _placed(first, bits, cell_rows).groupBy("root").agg(F.min("best").alias("best")).select("best.n")
    return rows.join(kept, "n", "left_semi").select("row.*")
