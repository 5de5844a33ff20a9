"""Products dealt to blocks of the result, multiplied in numpy where their entries are.

Rows of A and columns of B are dealt by hash to blocks; every (row block, column block) is a place of the result and one
partition.  A's entries are packed, some hundred thousand to a record of compressed byte planes, and shuffled to their
row block, B's to their column block, once each: a place is a pair of partitions of a Cartesian product, which reads its two blocks
from where they lie, so the disk does not follow the number of places.  The entries of a matrix to be added go to their one
place.  A place forms its cells a slab of rows at a time in a dense buffer of ``SLAB_CELLS``, so neither partial products nor
sums are shuffled or spilled, and its memory follows the entries of its blocks.  Outer products of vectors are added a slab at a time.

A product whose right side is such a product itself (P9) is formed in the same places (:func:`dealt_chain`): a slab of the inner
product is multiplied as soon as it is formed, and its cells never leave the place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import canon, ship_package

PACKED = 1 << 18  # entries packed at a time
SLAB_CELLS = 1 << 22
SENT_ROWS = 1 << 17  # rows of a result batch
NO_INDEX = np.iinfo(np.int64).min  # a NULL index; stored indices are not negative
CHAIN_WIDTH = 1 << 13  # columns of a chain formed at a time, at most
CHAIN_CELLS = 1 << 25  # sums held at a time
DENSE_TERMS = 64  # a product is formed from dense sides where that takes at most so many times its terms
_RECORD = "b int, side int, x binary, k binary, v binary"


def _planes(x: np.ndarray) -> bytes:
    """The number of values, then the first bytes of all values, the second ones, and so on, compressed: equal bytes lie together."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8).T.tobytes(), "zstd", asbytes=True)


def _unplane(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd"), np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def _packed(entries: DataFrame, block: Column, side: int) -> DataFrame:
    """Records of the entries ``(x, k, v)`` of one ``block``."""

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        b = t.column("b").to_numpy()
        x, k = (t.column(c).fill_null(NO_INDEX).to_numpy() for c in ("x", "k"))
        v = t.column("v").to_numpy()
        order = np.lexsort((k, b))
        cuts = np.flatnonzero(np.append(True, np.diff(b[order]) != 0))
        for lo, hi in zip(cuts, [*cuts[1:], len(b)]):
            rows = order[lo:hi]
            columns = [pa.array([int(b[rows[0]])], pa.int32()), pa.array([side], pa.int32()), *[pa.array([_planes(c[rows])], pa.binary()) for c in (x, k, v)]]
            yield pa.RecordBatch.from_arrays(columns, names=["b", "side", "x", "k", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield from pack(held)
                held, n = [], 0
        if n:
            yield from pack(held)

    return entries.filter(F.col("v").isNotNull()).select(block.cast("int").alias("b"), "x", "k", "v").mapInArrow(run, _RECORD)


class _Place:
    """What one place was sent, ready to form cells: A's entries by row, B's by inner index."""

    def __init__(self, parts: dict[int, list[tuple]]):
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        (i, k, self.va), (j, inner, vb), (ci, cj, cv), x, y = ([np.concatenate(c) for c in zip(*sent)] if (sent := parts.pop(s, None)) else none for s in range(5))
        order = np.argsort(inner, kind="stable")
        inner, j, self.vb = inner[order], j[order], vb[order]
        lo, hi = (np.searchsorted(inner, k, side) for side in ("left", "right"))
        met = hi > lo
        i, self.va, lo, hi = i[met], self.va[met], lo[met], hi[met]
        self.rows, at = np.unique(np.concatenate([i, ci, x[0]]), return_inverse=True)
        self.columns, self.j = np.unique(np.concatenate([j, cj, y[0]]), return_inverse=True)
        self.outer = [self._values(n, at, x, self.j, y) for n in np.intersect1d(x[1], y[1])]
        at, self.j = at[: len(i) + len(ci)], self.j[: len(j) + len(cj)]
        order = np.argsort(at[: len(i)], kind="stable")
        self.i, self.va, self.lo, self.count = at[: len(i)][order], self.va[order], lo[order], (hi - lo)[order]
        order = np.argsort(at[len(i) :], kind="stable")
        self.ci, self.cj, self.cv = at[len(i) :][order], self.j[len(j) :][order], cv[order]
        self.j = self.j[: len(j)]

    def _values(self, n: int, at: np.ndarray, x: list, to: np.ndarray, y: list) -> tuple[np.ndarray, ...]:
        """Of outer product n: for all rows the values of x and whether there is one, and the same of y for all columns."""
        out = []
        for places, (_, term, v), size in ((at[len(at) - len(x[0]) :], x, len(self.rows)), (to[len(to) - len(y[0]) :], y, len(self.columns))):
            own = places[term == n]
            out += [np.bincount(own, v[term == n], size), np.bincount(own, minlength=size) > 0]
        return tuple(out)

    def _add_outer(self, cells: np.ndarray, top: int) -> None:
        """Adds the outer products to a slab of the product, whose NaN are no stored cells."""
        cells[np.isnan(cells)] = 0.0
        for x, has_x, y, has_y in self.outer:
            x, has_x = x[top : top + len(cells)], has_x[top : top + len(cells)]
            if _finite(x, y):
                cells += x[:, None] * y
            else:
                with np.errstate(all="ignore"):
                    cells[np.ix_(has_x, has_y)] += x[has_x, None] * y[has_y]

    def _add_dense(self, cells: np.ndarray, a: int, b: int, top: int) -> bool:
        """Adds the terms of A's entries a to b to a slab, as a product of dense sides if these are small for so many terms."""
        height, width = cells.shape
        if self.count[a:b].sum() * DENSE_TERMS < cells.size:
            return False
        starts, once, at = np.unique(self.lo[a:b], return_index=True, return_inverse=True)
        each = self.count[a:b][once]
        met = _ranges(starts, each)  # B's entries under the inner indices
        if len(starts) * cells.size > DENSE_TERMS * self.count[a:b].sum() or len(starts) * max(height, width) > 4 * SLAB_CELLS or not _finite(self.va[a:b], self.vb[met]):
            return False
        right = _spread(np.repeat(np.arange(len(starts)), each), self.j[met], self.vb[met], len(starts), width)
        cells += _spread(self.i[a:b] - top, at, self.va[a:b], height, len(starts)) @ right
        return True

    def slabs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, columns and values of the cells that are not zero or NaN."""
        width = max(1, len(self.columns))
        for top, cells in self._formed():
            kept = np.flatnonzero((cells != 0) & ~np.isnan(cells))
            for part in np.array_split(kept, max(1, -(-len(kept) // SENT_ROWS))):
                yield self.rows[top + part // width], self.columns[part % width], cells[part]

    def count_cells(self) -> int:
        return sum(int(np.count_nonzero(cells) - np.count_nonzero(np.isnan(cells))) for _, cells in self._formed())

    def _formed(self) -> Iterator[tuple[int, np.ndarray]]:
        """The first row of each slab and all its cells."""
        width = max(1, len(self.columns))
        step = max(1, SLAB_CELLS // width)
        for top in range(0, len(self.rows), step):
            height = min(step, len(self.rows) - top)
            cells = np.zeros(height * width)
            a, b = np.searchsorted(self.ci, (top, top + height))
            cells += np.bincount((self.ci[a:b] - top) * width + self.cj[a:b], self.cv[a:b], len(cells))
            a, b = np.searchsorted(self.i, (top, top + height))
            if self._add_dense(cells.reshape(height, width), a, b, top):
                a = b
            done = np.append(0, np.cumsum(self.count[a:b]))
            while a < b:
                first = len(done) - 1 - (b - a)
                n = max(1, int(np.searchsorted(done, done[first] + SLAB_CELLS, "right")) - 1 - first)
                each = self.count[a : a + n]
                own = np.repeat(np.arange(a, a + n), each)
                other = np.arange(len(own)) + np.repeat(self.lo[a : a + n] - (np.cumsum(each) - each), each)
                cells += np.bincount((self.i[own] - top) * width + self.j[other], self.va[own] * self.vb[other], len(cells))
                a += n
            if self.outer:
                self._add_outer(cells.reshape(height, width), top)
            yield top, cells


def _finite(*arrays: np.ndarray) -> bool:
    with np.errstate(all="ignore"):
        return all(np.isfinite(a.sum()) for a in arrays)


def _spread(i: np.ndarray, j: np.ndarray, v: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.bincount(i * width + j, v, height * width).reshape(height, width)


def _add_product(out: np.ndarray, at: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], cells: np.ndarray) -> None:
    """``out[:, at] += O cells`` for the entries ``(row of out, row of cells, v)`` of O; an absent cell has no terms."""
    order = np.argsort(entries[0], kind="stable")
    rows, inner, v = (x[order] for x in entries)
    if not len(rows):
        return
    height, width = cells.shape
    finite = _finite(v, cells)

    def add(met: np.ndarray, sums: np.ndarray) -> None:
        if len(at) == out.shape[1]:
            out[met] += sums
        else:
            out[np.ix_(met, at)] += sums

    met, place = np.unique(rows, return_inverse=True)
    if finite and len(met) * height <= min(DENSE_TERMS * len(rows), 4 * SLAB_CELLS):
        add(met, _spread(place, inner, v, len(met), height) @ cells)
        return
    step = max(1, SLAB_CELLS // 64 // max(1, width))  # a few hundred kilobytes
    for a in range(0, len(rows), step):
        part = slice(a, a + step)
        other = cells[inner[part]]
        with np.errstate(all="ignore"):
            terms = other * v[part, None]
            if not finite:
                terms[other == 0] = 0.0
            first = np.flatnonzero(np.append(True, np.diff(rows[part]) != 0))
            add(rows[part][first], np.add.reduceat(terms, first, axis=0))


def _ranges(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``lo``, ``lo + 1``, ... of every range, one range after another."""
    return np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)


class _ChainPlace:
    """What one place of a chain ``O (... (L R))`` was sent, as ``(row, column, v)`` a factor.  Rows of L and columns of R are put in
    the order of their least inner index, so that a slab of rows has terms in few columns, and those are all it has."""

    def __init__(self, factors: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        *outer, (i, k, lv), (inner, j, rv) = factors
        below, at = self._by_least(i, k)
        order = np.argsort(at, kind="stable")
        self.l, self.lk, self.lv = at[order], k[order], lv[order]
        self.columns, at = self._by_least(j, inner)
        order = np.argsort(at, kind="stable")
        self.r, self.rk, self.rv = at[order], inner[order], rv[order]
        self.outer = []  # from the innermost one: (row, row of what it is multiplied with, v) by the second, and the number of rows
        for i, k, v in reversed(outer):
            by = np.argsort(below)
            near = np.searchsorted(below, k, sorter=by)
            near = by[np.minimum(near, len(by) - 1)] if len(by) else np.zeros(len(k), np.int64)
            met = below[near] == k if len(by) else np.zeros(len(k), bool)
            below, at = np.unique(i[met], return_inverse=True)
            order = np.argsort(near[met], kind="stable")
            self.outer.append((at[order], near[met][order], v[met][order], len(below)))
        self.rows = below

    @staticmethod
    def _by_least(x: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct x in the order of their least k, and the place of each x there."""
        labels, at = np.unique(x, return_inverse=True)
        order = np.lexsort((k, at))
        by = np.argsort(k[order][np.searchsorted(at[order], np.arange(len(labels)))], kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        return labels[by], place[at]

    def _slabs(self, inner: np.ndarray, column: np.ndarray, rv: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, columns, cells)`` of ``L R``, a slab of rows at a time; R's entries are in the order of ``inner``."""
        lo, hi = (np.searchsorted(inner, self.lk, side) for side in ("left", "right"))
        met = hi > lo
        row, k, lv, lo, count = self.l[met], self.lk[met], self.lv[met], lo[met], (hi - lo)[met]
        done = np.append(0, np.cumsum(count))
        a = 0
        while a < len(row):
            # Whole rows, one at least, as many as their terms and their cells in all columns allow.
            top = min(np.searchsorted(done, done[a] + SLAB_CELLS, "right") - 1, np.searchsorted(row, row[a] + max(1, 4 * SLAB_CELLS // width)))
            b = int(top) if top >= len(row) else int(np.searchsorted(row, row[min(top, len(row) - 1)]))
            b = max(b, int(np.searchsorted(row, row[a], "right")))
            at, height = row[a:b] - row[a], int(row[b - 1] - row[a]) + 1
            ks, once, at_k = np.unique(k[a:b], return_index=True, return_inverse=True)
            each = count[a:b][once]
            reached = _ranges(lo[a:b][once], each)  # R's entries under these inner indices
            columns, at_c = np.unique(column[reached], return_inverse=True)
            if len(ks) * height * len(columns) <= DENSE_TERMS * (done[b] - done[a]) and (len(ks) * max(height, len(columns)) <= 4 * SLAB_CELLS) and _finite(lv[a:b], rv[reached]):
                right = _spread(np.repeat(np.arange(len(ks)), each), at_c, rv[reached], len(ks), len(columns))
                cells = _spread(at, at_k, lv[a:b], height, len(ks)) @ right
            else:
                cells = np.zeros((height, len(columns)))
                first = np.cumsum(each) - each  # where an inner index begins in ``reached``
                n = max(1, SLAB_CELLS // max(1, int(each.max())))
                for c in range(0, b - a, n):
                    part = at_k[c : c + n]
                    other = _ranges(first[part], each[part])
                    with np.errstate(all="ignore"):
                        terms = np.repeat(lv[a:b][c : c + n], each[part]) * rv[reached][other]
                    cells += _spread(np.repeat(at[c : c + n], each[part]), at_c[other], terms, height, len(columns))
                cells[np.isnan(cells)] = 0.0
            yield int(row[a]), columns, cells
            a = b

    def results(self, partial: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Cells of the chain for some columns at a time.  ``partial`` sums are added to others, so their NaN are kept."""
        most = max(n for *_, n in self.outer)
        width = max(1, min(CHAIN_WIDTH, CHAIN_CELLS // max(1, most)))
        for left in range(0, len(self.columns), width):
            labels = self.columns[left : left + width]
            a, b = np.searchsorted(self.r, (left, left + len(labels)))
            order = np.argsort(self.rk[a:b], kind="stable")
            inner, column, rv = self.rk[a:b][order], self.r[a:b][order] - left, self.rv[a:b][order]
            rows, other, v, n = self.outer[0]
            sums = np.zeros((n, len(labels)))
            for first, columns, cells in self._slabs(inner, column, rv, len(labels)):
                a, b = np.searchsorted(other, (first, first + len(cells)))
                _add_product(sums, columns, (rows[a:b], other[a:b] - first, v[a:b]), cells)
            for rows, other, v, n in self.outer[1:]:
                below, sums = sums, np.zeros((n, len(labels)))
                below[np.isnan(below)] = 0.0
                step = max(1, 4 * SLAB_CELLS // len(labels))
                for first in range(0, len(below), step):
                    a, b = np.searchsorted(other, (first, first + step))
                    _add_product(sums, np.arange(len(labels)), (rows[a:b], other[a:b] - first, v[a:b]), below[first : first + step])
            flat = sums.ravel()
            kept = np.flatnonzero((flat != 0) if partial else (flat != 0) & ~np.isnan(flat))
            for part in np.array_split(kept, max(1, -(-len(kept) // SENT_ROWS))):
                yield self.rows[part // len(labels)], labels[part % len(labels)], flat[part]


def dealt_chain(factors: list[DataFrame], grid: tuple[int, int]) -> DataFrame:
    """``(i, j, v)`` of ``F1 (F2 (... Fn))``, three factors or more of ``i, j, v``, each product's zeros and NaN left out.

    Columns of the first and rows of the second factor are dealt to ``rows`` blocks, columns of the last one to ``cols``; a factor
    between is sent to every place whole.  With more than one row block the places' sums are added up."""
    rows, cols = grid
    last = len(factors) - 1
    ship_package(factors[0].sparkSession)
    ids = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = ["side", "x", "k", "v"]
    sent = []
    for side, m in enumerate(factors):
        known = [F.col(c).isNotNull() for c in ([] if side == 0 else ["i"]) + ([] if side == last else ["j"])]
        e = m.filter(reduce(Column.__and__, known)).select(F.col("i").alias("x"), F.col("j").alias("k"), "v")
        if side == last:
            part = _packed(e, F.pmod(F.xxhash64("k"), F.lit(cols)), side).select("*", ids(rows).alias("o"))
            places = F.col("o") * cols + F.col("b")
        elif side < 2:
            part = _packed(e, F.pmod(F.xxhash64("x" if side else "k"), F.lit(rows)), side).select("*", ids(cols).alias("o"))
            places = F.col("b") * cols + F.col("o")
        else:
            part = _packed(e, F.lit(0), side).select("*", ids(rows * cols).alias("o"))
            places = F.col("o")
        sent.append(part.select(places.alias("place"), *data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[tuple]] = [[] for _ in range(last + 1)]
        for batch in batches:
            for side, x, k, v in zip(*(batch.column(n).to_pylist() for n in data)):
                parts[side].append((_unplane(x, np.int64), _unplane(k, np.int64), _unplane(v, np.float64)))
        if not all(parts):
            return
        place = _ChainPlace([tuple(np.concatenate(c) for c in zip(*sent)) for sent in parts])
        parts.clear()
        for i, j, v in place.results(rows > 1):
            index = (pa.array(x, mask=x == NO_INDEX) for x in (i, j))
            yield pa.RecordBatch.from_arrays([*index, pa.array(v)], names=["i", "j", "v"])

    out = reduce(DataFrame.unionByName, sent).repartitionById(rows * cols, F.col("place")).select("place", *data).mapInArrow(run, "i long, j long, v double")
    return canon(out.groupBy("i", "j").agg(F.sum("v").alias("v"))) if rows > 1 else out


def _met(left: list[DataFrame], right: list[DataFrame], grid: tuple[int, int], half: bool = False) -> DataFrame:
    """``(r, c, side, x, k, v)``: the records of ``left``'s row block r and ``right``'s column block c, a place a partition.

    Records are ``b, o, side, x, k, v`` of block b; ``o`` names the only column block that a record of ``left`` goes to, or is -1.  Both
    are shuffled once, and a pair of partitions is read by its place.  Every block has one empty record, and another record is met
    with the other block's empty one alone, so a place reads each once.  ``half``: only places with ``r <= c``."""
    spark = left[0].sparkSession

    def blocks(records: list[DataFrame], n: int, name: str) -> DataFrame:
        nothing = [F.lit(None).cast("binary").alias(c) for c in ("x", "k", "v")]
        empty = spark.range(n).select(F.col("id").cast("int").alias("b"), F.lit(-1).alias("o"), F.lit(-1).alias("side"), *nothing)
        out = reduce(DataFrame.unionByName, records, empty).repartitionById(n, F.col("b"))
        return out.select([F.col(c).alias(f"{name}{c}") for c in empty.columns])

    own = (F.col("l_side") < 0) | ((F.col("r_side") < 0) & ((F.col("l_o") < 0) | (F.col("l_o") == F.col("r_b"))))
    if half:
        own = own & (F.col("l_b") <= F.col("r_b"))
    pairs = blocks(left, grid[0], "l_").hint("shuffle_replicate_nl").join(blocks(right, grid[1], "r_"), own)
    data = [F.when(F.col("l_side") < 0, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(c) for c in ("side", "x", "k", "v")]
    return pairs.select(F.col("l_b").alias("r"), F.col("r_b").alias("c"), *data)


def dealt_product(
    left: DataFrame,
    right: DataFrame,
    grid: tuple[int, int],
    added: DataFrame | None = None,
    half: bool = False,
    outer: tuple[DataFrame, DataFrame] | None = None,
    count: bool = False,
) -> DataFrame:
    """``(i, j, v)`` of ``L R + C``, zeros and NaN left out; ``left``: i, k, v, ``right``: k, j, v, ``added``: i, j, v.

    ``half`` states that ``L R`` is symmetric and the grid square: only places on and above its diagonal are formed, and those
    above are mirrored.  ``outer``: two tables ``i, k, v`` and ``k, j, v`` of few ``k``, whose product is added to the stored cells.
    ``count``: every cell is formed, and ``n``, the number of a place's cells, is returned in their stead."""
    rows, cols = grid
    ship_package(left.sparkSession)
    r, c = (F.pmod(F.xxhash64(x), F.lit(n)).cast("int") for x, n in (("x", rows), ("k", cols)))
    own = F.pmod(F.xxhash64("x"), F.lit(cols))

    def sent(m: DataFrame, index: str, block: Column, side: int) -> DataFrame:
        e = m.filter(F.col("k").isNotNull()).select(F.col(index).alias("x"), F.col("k").cast("long").alias("k"), "v")
        return _packed(e, block, side).select("b", F.lit(-1).alias("o"), "side", "x", "k", "v")

    a, b = [sent(left, "i", r, 0)], [sent(right, "j", own, 1)]
    if added is not None:
        cells = added.select(F.col("i").alias("x"), F.col("j").alias("k"), "v")
        at = _packed(cells, r * F.lit(cols) + c, 2)
        a.append(at.select((F.col("b") / F.lit(cols)).cast("int").alias("b"), (F.col("b") % F.lit(cols)).alias("o"), "side", "x", "k", "v"))
    if outer is not None:
        a.append(sent(outer[0], "i", r, 3))
        b.append(sent(outer[1], "j", own, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        r = c = 0
        for batch in batches:
            for r, c, side, x, k, v in zip(*(batch.column(n).to_pylist() for n in ("r", "c", "side", "x", "k", "v"))):
                if side >= 0:
                    parts.setdefault(side, []).append((_unplane(x, np.int64), _unplane(k, np.int64), _unplane(v, np.float64)))
        if not parts:
            return
        if count:
            formed = _Place(parts).count_cells()
            yield pa.RecordBatch.from_arrays([pa.array([formed * (2 if half and r != c else 1)])], names=["n"])
            return
        for i, j, v in _Place(parts).slabs():
            index = (pa.array(x, mask=x == NO_INDEX) for x in (i, j))
            cells = pa.RecordBatch.from_arrays([*index, pa.array(v)], names=["i", "j", "v"])
            yield cells
            if half and r != c:
                yield pa.RecordBatch.from_arrays([cells.column("j"), cells.column("i"), cells.column("v")], names=["i", "j", "v"])

    # One place a partition, so that what a task holds is what its place reads.
    return _met(a, b, grid, half).mapInArrow(run, "n long" if count else "i long, j long, v double")
