"""Generated matrices formed in numpy where the entries they meet are (S11-S13, S16 against a stored matrix).

The generators of :mod:`tessera.sources.entries` draw a cell from the hash of its indices.  Here the same cells are drawn, all of
them, a buffer of ``DRAWN_CELLS`` at a time: columns (or lines) are dealt by hash to places, a stored matrix's entries are packed
and sent to the places of their columns, and a place draws its columns one after another and adds, multiplies or counts
the entries among them.  Drawn cells are no rows, so neither a join nor an aggregate has one row per cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import ship_package
from tessera.plans.blocks import NO_INDEX, SENT_ROWS, _packed, _unplane

DRAWN_CELLS = 1 << 14  # cells drawn at a time, in buffers that stay in a core's cache
_ALL = (1 << 64) - 1
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_SPARK_SEED = 42
_LOW53 = np.uint64((1 << 53) - 1)
_GOLDEN = 0x9E3779B9  # between the seeds of a normal draw's two hashes


def _u(x: int) -> np.uint64:
    return np.uint64(x & _ALL)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(h: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The last steps of XXH64 in place; ``free`` is a buffer of the same shape."""
    for shift, factor in ((33, _P2), (29, _P3), (32, None)):
        np.right_shift(h, np.uint64(shift), out=free)
        np.bitwise_xor(h, free, out=h)
        if factor:
            np.multiply(h, _u(factor), out=h)
    return h


def _key(x: np.ndarray) -> np.ndarray:
    """What a long brings into the hash."""
    return _turn(np.asarray(x).astype(np.uint64) * _u(_P2), 31) * _u(_P1)


def _met(h: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The hash in place, of seeds (plus ``_P5 + 8``) that a long's key has been mixed into."""
    np.left_shift(h, np.uint64(27), out=free)
    np.right_shift(h, np.uint64(37), out=h)
    np.bitwise_or(h, free, out=h)
    np.multiply(h, _u(_P1), out=h)
    np.add(h, _u(_P4), out=h)
    return _mixed(h, free)


def hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Spark's ``xxhash64`` of longs, from the seed or the hash so far."""
    h = np.atleast_1d((seed + _u(_P5 + 8)) ^ _key(x))
    return _met(h, np.empty_like(h))


def hash_seed(seed: int) -> np.uint64:
    """Spark's ``xxhash64`` of a literal: an INT, or a BIGINT where it is too large."""
    if -(1 << 31) <= seed < 1 << 31:
        h = np.atleast_1d(_u(_SPARK_SEED + _P5 + 4) ^ _u((seed & 0xFFFFFFFF) * _P1))
        h = _turn(h, 23) * _u(_P2) + _u(_P3)
        return _mixed(h, np.empty_like(h))[0]
    return hash_long(np.array([seed], np.int64), _u(_SPARK_SEED))[0]


def _unit(h: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Hashes as uniform draws on [0, 1), in a buffer of doubles."""
    np.bitwise_and(h, _LOW53, out=h)
    np.multiply(h.view(np.int64), 2.0**-53, out=free)
    return free


class _Draws:
    """Draws of cells ``(i, j)`` from the hash of seed, i, j; the share of i in it is kept for all rows."""

    def __init__(self, nrows: int, seed: int, normal: bool):
        seeds = [seed, seed + _GOLDEN] if normal else [seed]
        i = np.arange(nrows)
        with np.errstate(over="ignore"):
            self.rows = [hash_long(i, hash_seed(s)) + _u(_P5 + 8) for s in seeds]
        self.normal = normal

    def at(self, rows: slice | np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Cells of some rows (last axis) and the columns of the given keys."""
        with np.errstate(over="ignore"):
            units = []
            for seeds in self.rows:
                h = seeds[rows] ^ keys
                free = np.empty_like(h)
                units.append(_unit(_met(h, free), free.view(np.float64)))
        if not self.normal:
            return units[0]
        u, w = units
        np.subtract(1.0, u, out=u)
        np.log(u, out=u)
        np.multiply(u, -2.0, out=u)
        np.sqrt(u, out=u)
        np.multiply(w, 2 * math.pi, out=w)
        return np.multiply(u, np.cos(w, out=w), out=u)


@dataclass(frozen=True)
class DenseCells:
    """Every cell is drawn, uniform on [lo, hi) or standard normal."""

    nrows: int
    ncols: int
    seed: int
    normal: bool = False
    lo: float = 0.0
    hi: float = 1.0

    def drawn(self, columns: np.ndarray) -> Iterator[np.ndarray]:
        """The cells of the columns one after another, whole columns or parts of one at a time."""
        draws, keys = _Draws(self.nrows, self.seed, self.normal), _key(columns)
        some = max(1, DRAWN_CELLS // max(1, self.nrows))
        for c in range(0, len(columns), some):
            for r in range(0, self.nrows, DRAWN_CELLS):
                v = draws.at(slice(r, r + DRAWN_CELLS), keys[c : c + some, None])
                if not self.normal:
                    np.multiply(v, self.hi - self.lo, out=v)
                    np.add(v, self.lo, out=v)
                yield v.ravel()


@dataclass(frozen=True)
class MaskCells:
    """Cell ``(a*t + off) mod (nrows*ncols)`` for ``t`` below ``k``, counted down the columns, with a uniform or normal value."""

    nrows: int
    ncols: int
    seed: int
    normal: bool
    a: int
    off: int
    k: int

    def drawn(self, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and values of each column's drawn cells: those whose ``t``, the cell less ``off`` times the inverse of ``a``, is below ``k``."""
        n = max(1, self.nrows * self.ncols)
        draws, keys, back = _Draws(self.nrows, self.seed, self.normal), _key(columns), pow(self.a, -1, n) if n > 1 else 0
        steps = np.array([(i * back) % n for i in range(self.nrows)], np.int64)
        for j, key in zip(columns.tolist(), keys):
            t = steps + ((j * self.nrows - self.off) * back) % n
            np.subtract(t, n, out=t, where=t >= n)
            rows = np.flatnonzero(t < self.k)
            yield rows, draws.at(rows, key)


@dataclass(frozen=True)
class LineCells:
    """S16 by rows: of line k the positions ``(a*t + off_k) mod width`` for ``t`` below its count, with a value on (0, 1]."""

    width: int
    seed: int
    a: int
    segments: tuple[tuple[int, int, int], ...]  # first line, end, count a line

    def drawn(self, lines: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(line, positions, values)`` for the lines that have any, a part of a line at a time."""
        most = max((c for *_, c in self.segments), default=0)
        steps = np.arange(most) * self.a % max(1, self.width)
        first = hash_seed(self.seed)
        for lo, hi, count in self.segments:
            own = lines[(lines >= lo) & (lines < hi)]
            with np.errstate(over="ignore"):
                off = _line_offsets(own, self.seed) % max(1, self.width)
                seeds = hash_long(own, first) + _u(_P5 + 8) if len(own) else own
            for line, start, seed in zip(own.tolist(), off.tolist(), seeds):
                for t in range(0, count, DRAWN_CELLS):
                    at = steps[t : min(count, t + DRAWN_CELLS)] + start
                    np.subtract(at, self.width, out=at, where=at >= self.width)
                    with np.errstate(over="ignore"):
                        h = _key(at)
                        np.bitwise_xor(h, seed, out=h)
                        free = np.empty_like(h)
                        v = _unit(_met(h, free), free.view(np.float64))
                    yield line, at, np.subtract(1.0, v, out=v)


def _line_offsets(lines: np.ndarray, seed: int) -> np.ndarray:
    """Spark's ``xxhash64(line, INT seed)``."""
    h = hash_long(lines, _u(_SPARK_SEED))
    h = (h + _u(_P5 + 4)) ^ _u((seed & 0xFFFFFFFF) * _P1)
    h = _turn(h, 23) * _u(_P2) + _u(_P3)
    return _mixed(h, np.empty_like(h)).view(np.int64)


def _places(q: DataFrame, key: str, size: int, parts: int, form: Callable, schema: str) -> DataFrame:
    """``form(own, x, k, v)`` in each of ``parts`` places: the columns (or lines) below ``size`` that are its own, and q's entries in
    them, x being the other index.  An entry of no such column (NULL) is sent to the first place."""
    ship_package(q.sparkSession)
    other = "i" if key == "j" else "j"
    place = F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("k"), F.lit(parts)))
    packed = _packed(q.select(F.col(other).alias("x"), F.col(key).alias("k"), "v"), place, 0)
    empty = q.sparkSession.range(parts).select(F.col("id").cast("int").alias("b"), F.lit(-1).alias("side"), *[F.lit(None).cast("binary").alias(c) for c in ("x", "k", "v")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        at = None
        for batch in batches:
            for at, side, x, k, v in zip(*(batch.column(n).to_pylist() for n in ("b", "side", "x", "k", "v"))):
                if side >= 0:
                    sent.append((_unplane(x, np.int64), _unplane(k, np.int64), _unplane(v, np.float64)))
        if at is None:
            return
        own = []
        for lo in range(0, size, 1 << 20):
            some = np.arange(lo, min(size, lo + (1 << 20)))
            with np.errstate(over="ignore"):
                own.append(some[hash_long(some, _u(_SPARK_SEED)).view(np.int64) % parts == at])
        x, k, v = (np.concatenate(c) for c in zip(*sent))
        sent.clear()
        yield from form(np.concatenate(own) if own else np.empty(0, np.int64), x, k, v)

    return empty.unionByName(packed).repartitionById(parts, F.col("b")).mapInArrow(run, schema)


def beside(q: DataFrame, cells: DenseCells, add: bool, parts: int) -> DataFrame:
    """``(i, j, v, q)``: ``Q + R`` (``add``) or ``Q`` times ``R`` cell by cell, at the cells that Q stores, beside Q; Q stores a cell
    once.  Zeros and NaN are left out."""

    def form(columns: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = (i >= 0) & (j >= 0)
        i, v = i[known], v[known]
        line = np.searchsorted(columns, j[known]) * cells.nrows + i
        order = np.argsort(line, kind="stable")
        line, v = line[order], v[order]
        out = np.empty(len(v))
        a = top = 0
        for drawn in cells.drawn(columns):
            b = a + int(np.searchsorted(line[a : a + len(drawn)], top + len(drawn)))
            if b > a:
                at = line[a:b] - top
                with np.errstate(all="ignore"):
                    drawn[at] = drawn[at] + v[a:b] if add else drawn[at] * v[a:b]
                out[a:b] = drawn[at]
            a, top = b, top + len(drawn)
        kept = np.flatnonzero((out != 0) & ~np.isnan(out))
        for lo in range(0, len(kept), SENT_ROWS):
            k = kept[lo : lo + SENT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (line[k] % cells.nrows, columns[line[k] // cells.nrows], out[k], v[k])], names=["i", "j", "v", "q"])

    return _places(q, "j", cells.ncols, parts, form, "i long, j long, v double, q double")


def mask_counts(q: DataFrame, cells: MaskCells, parts: int) -> DataFrame:
    """``(mask, q_nnz, most, under)`` a place, where it has any cell: the mask's entries, Q's, the most entries of the mask in a
    cell, and the cells where both have one."""

    def form(columns: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = (i >= 0) & (j >= 0)
        line = np.searchsorted(columns, j[known])
        order = np.argsort(line, kind="stable")
        line, row = line[order], i[known][order]
        ends = np.searchsorted(line, np.arange(len(columns) + 1))
        mask = most = under = 0
        for n, (rows, values) in enumerate(cells.drawn(columns)):
            times = np.bincount(rows[(values != 0) & ~np.isnan(values)], minlength=cells.nrows)
            mask, most = mask + int(times.sum()), max(most, int(times.max(initial=0)))
            own = row[ends[n] : ends[n + 1]]
            if len(own):
                met, stored = np.unique(own, return_counts=True)
                under += int(np.count_nonzero(times[met] * stored == 1))
        if mask or len(v):
            yield pa.RecordBatch.from_pydict({"mask": [mask], "q_nnz": [len(v)], "most": [most], "under": [under]})

    return _places(q, "j", cells.ncols, parts, form, "mask long, q_nnz long, most long, under long")


def line_counts(q: DataFrame, cells: LineCells, nrows: int, parts: int, outside: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``(line, cnt, q_nnz, out_of_range)``: entries of the generator and of Q in every line that has any, and the cells that both
    have where ``outside(v, q)``."""

    def form(lines: np.ndarray, j: np.ndarray, i: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(i, kind="stable")
        i, j, v = i[order], j[order], v[order]
        names, first, stored = np.unique(i, return_index=True, return_counts=True)
        found = {int(n): [0, int(c), 0] for n, c in zip(names, stored)}
        place = {int(n): slice(a, a + c) for n, a, c in zip(names, first, stored)}
        near = np.full(cells.width, -1, np.int64)  # Q's entry of a position of the line
        held = -1
        for line, at, drawn in cells.drawn(lines):
            one = found.setdefault(line, [0, 0, 0])
            one[0] += len(at)
            if line != held:
                if held in place:
                    near[j[place[held]][j[place[held]] >= 0]] = -1
                held = line
                if line in place:
                    own = np.arange(place[line].start, place[line].stop)[j[place[line]] >= 0]
                    near[j[own]] = own
            if line in place:
                entry = near[at]
                met = np.flatnonzero(entry >= 0)
                one[2] += int(np.count_nonzero(outside(drawn[met], v[entry[met]])))
        names = np.fromiter(found, np.int64, len(found))
        counts = np.array(list(found.values()), np.int64).reshape(-1, 3)
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array(names, mask=names == NO_INDEX), *map(pa.array, counts.T.copy())], names=["line", "cnt", "q_nnz", "out_of_range"])

    return _places(q, "i", nrows, parts, form, "line long, cnt long, q_nnz long, out_of_range long")
