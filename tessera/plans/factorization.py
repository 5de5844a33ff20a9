"""Non-negative factorisation, gradient and quasi-Newton step.

The factorisation keeps its factors as wide rows: one row per index with an array
of the ``r`` values, so an entry of the data matrix meets a factor once and
carries ``r`` products into ``r`` sums of one aggregate.  The gradient and the
quasi-Newton step are compositions of the entry-table operators.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Mat, Vec, canon, cut_bucketed, cut_lineage, drop_lineage, fits_broadcast, require, ship_package
from tessera.operators import algebra as J
from tessera.operators import elementwise as E
from tessera.operators.reshape import vec, vec_stack
from tessera.plans.skew import join_prepared, prepare_repeated_join

_WIDE = "x long, f array<double>"


def _wide(df: DataFrame, index: str, column: str, r: int) -> DataFrame:
    """``(x, f)``: the ``r`` values of each index that has one, absent values 0."""
    value = lambda k: F.coalesce(F.sum(F.when(F.col(column) == k, F.col("v"))), F.lit(0.0))
    return df.groupBy(F.col(index).alias("x")).agg(F.array(*[value(k) for k in range(r)]).alias("f"))


def _entries(wide: DataFrame, index: str, column: str) -> DataFrame:
    """The stored entries of a wide factor; zeros and NaN are none."""
    cells = wide.select(F.col("x").alias(index), F.posexplode("f").alias("k", "v"))
    return canon(cells.select(index, F.col("k").cast("long").alias(column), "v")).select("i", "j", "v")


def _values(batch: pa.RecordBatch, column: str, r: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, r)


def _gram(wide: DataFrame, r: int) -> np.ndarray:
    """``Fᵀ F`` (r x r): a task adds up its rows, Spark the tasks' cells, and r² of them reach the driver."""
    ship_package(wide.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((r, r))
        for batch in batches:
            f = _values(batch, "f", r)
            total += f.T @ f
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(r * r, dtype=np.int32)), pa.array(total.ravel())], names=["at", "v"])

    cells = wide.select("f").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(r * r)
    for row in cells:
        out[row["at"]] = row["v"]
    return out.reshape(r, r)


def _updated(factor: DataFrame, sums: DataFrame, gram: np.ndarray, eps: float) -> DataFrame:
    """``f * s / (f G + eps)`` row by row where all three are stored, else 0."""
    r = len(gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, s = _values(batch, "f", r), _values(batch, "s", r)
            below = f @ gram
            stored = (f * s != 0) & (below != 0)
            with np.errstate(all="ignore"):
                new = np.where(stored, f * s / (below + eps), 0.0).ravel()
            lists = pa.ListArray.from_arrays(np.arange(0, len(new) + 1, r, dtype=np.int32), new)
            yield pa.RecordBatch.from_arrays([batch.column("x"), lists], names=["x", "f"])

    return factor.join(sums, "x").select("x", "f", "s").mapInArrow(run, _WIDE)


class _Data:
    """A fixed data matrix for products with changing wide factors.

    Factors that are small by their shapes are broadcast to the matrix, which is
    cached once.  Larger ones are shuffled to copies of it that are salted
    on hot indices, partitioned once by row and once by column, and cached.
    Either way a product joins each stored entry once.
    """

    def __init__(self, V: Mat, small: bool, num_partitions: int | None = None):
        base = V.df.select("i", "j", "v")
        self.small = small
        self.side = {}
        if small:
            cached = base.persist(StorageLevel.MEMORY_AND_DISK)
            self.side = {"i": (cached, None), "j": (cached, None)}
        else:
            for key in ("i", "j"):
                prepared, hot = prepare_repeated_join(base, [key], num_partitions)
                self.side[key] = (prepared.persist(StorageLevel.MEMORY_AND_DISK), hot)

    def cut(self, factor: DataFrame, key: str, in_place: bool = False) -> DataFrame:
        return cut_lineage(factor)

    def sums(self, factor: DataFrame, key: str, r: int) -> DataFrame:
        """``(x, s)``: for every index of the other side the ``r`` sums of ``v * f`` over its entries."""
        data, hot = self.side[key]
        f = factor.select(F.col("x").alias(key), "f")
        joined = data.join(F.broadcast(f), key) if self.small else join_prepared(data, hot, f, [key])
        other = "j" if key == "i" else "i"
        total = [F.sum(F.col("v") * F.col("f")[k]) for k in range(r)]
        return joined.groupBy(F.col(other).alias("x")).agg(F.array(*total).alias("s"))

    def release(self) -> None:
        for data, _ in self.side.values():
            data.unpersist()


FACTOR_CELLS = 1 << 21  # cells of the longer factor in a bucket, about


class _InPlace:
    """A fixed data matrix for products with changing wide factors, of which the shorter is small by its shape.

    The matrix is written once, bucketed by the index of its longer side, and that side's factor
    lies in the same buckets.  The shorter factor is broadcast, and the sums it leads to are
    complete where the entries are; the longer one meets the entries bucket by bucket, and
    only its sums are shuffled: at most one row per index of the shorter side and bucket, whose number does not
    follow the entries.  An index of the longer side has no more entries than the shorter side's size, so none is hot."""

    def __init__(self, V: Mat, r: int, num_partitions: int | None = None):
        self.key, size = ("j", V.ncols) if V.ncols >= V.nrows else ("i", V.nrows)
        self.buckets = num_partitions or max(2 * V.spark.sparkContext.defaultParallelism, math.ceil(size * r / FACTOR_CELLS))
        self.data = cut_bucketed(V.df.select("i", "j", "v"), self.buckets, self.key)

    def cut(self, factor: DataFrame, key: str, in_place: bool = False) -> DataFrame:
        """The factor of the index ``key``, written; ``in_place`` states that it was made of one that was cut here."""
        return cut_bucketed(factor, self.buckets, "x", in_place) if key == self.key else cut_lineage(factor)

    def sums(self, factor: DataFrame, key: str, r: int) -> DataFrame:
        """As :meth:`_Data.sums`."""
        f = factor.select(F.col("x").alias(key), "f")
        joined = self.data.join(f.hint("shuffle_hash") if key == self.key else F.broadcast(f), key)
        total = [F.sum(F.col("v") * F.col("f")[k]) for k in range(r)]
        return joined.groupBy(F.col("i" if key == "j" else "j").alias("x")).agg(F.array(*total).alias("s"))

    def release(self) -> None:
        drop_lineage(self.data)


def _step(data: _Data | _InPlace, W: DataFrame, H: DataFrame, r: int, eps: float) -> tuple[DataFrame, DataFrame]:
    """One update of the wide factors; each is written to the checkpoint folder, since the next one reads it several times."""
    H = data.cut(_updated(H, data.sums(W, "i", r), _gram(W, r), eps), "j", in_place=True)
    W = data.cut(_updated(W, data.sums(H, "j", r), _gram(H, r), eps), "i", in_place=True)
    return W, H


def gnmf_step(V: Mat, W: Mat, H: Mat, eps: float = 1e-8) -> tuple[Mat, Mat]:
    """P6 one step: ``H <- H * (WᵀV) / ((WᵀW)H + eps)``, then
    ``W <- W * (VHᵀ) / (W(HHᵀ) + eps)``; eps is added to stored entries only.
    """
    return gnmf(V, W, H, 1, eps)


def gnmf(
    V: Mat, W: Mat, H: Mat, iterations: int = 10, eps: float = 1e-8, num_partitions: int | None = None
) -> tuple[Mat, Mat]:
    """``iterations`` multiplicative updates.

    A product against V is one join of its entries with the wide factor and one
    aggregate with ``r`` sums, so what is joined are nnz(V) rows and what is
    shuffled at most one row per index and task; where the shorter factor is small by its shape and the longer one is not,
    one row per index of the shorter side and bucket (:class:`_InPlace`).  The r x r Gram matrices are summed in
    the tasks, and an update is one pass over a factor's rows.  Both factors
    are cut from their lineage after every update with a reliable checkpoint
    in ``spark.checkpoint.dir``, so each step plans against two small tables
    and a lost executor recomputes at most one step."""
    require(W.ncols == H.nrows and V.shape == (W.nrows, H.ncols), "factor shapes do not match")
    r = W.ncols
    if iterations <= 0:
        return W, H
    spark = V.spark
    small = [fits_broadcast(spark, m.cell_bound) for m in (W, H)]
    data = _InPlace(V, r, num_partitions) if any(small) and not all(small) else _Data(V, all(small), num_partitions)
    w, h = data.cut(_wide(W.df, "i", "j", r), "i"), data.cut(_wide(H.df, "j", "i", r), "j")
    for _ in range(iterations):
        before = w, h
        w, h = _step(data, w, h, r, eps)
        for table in before:
            drop_lineage(table)
    # The returned factors are read back from the checkpoint folder, so the cached copies of V can be released.
    data.release()
    return Mat(_entries(w, "i", "j"), W.nrows, r), Mat(_entries(h, "j", "i"), r, H.ncols)


def gradient(V: Mat, W: Mat, H: Mat) -> Vec:
    """``dW = -2 (V - WH) Hᵀ + 2W``, ``dH = -2 Wᵀ (V - WH) + 2H``,
    returned as ``[vec dW; vec dH]`` (ruling R14: stacked by size).

    ``WH`` is never formed: ``(V - WH) Hᵀ = V Hᵀ - W (H Hᵀ)`` and
    ``Wᵀ (V - WH) = Wᵀ V - (Wᵀ W) H``, so the only intermediates are r x r and
    those of the factors' shapes.
    """
    Wt, Ht = E.transpose(W), E.transpose(H)
    dW = J.add_many([E.scale(J.matmul(V, Ht), -2.0), E.scale(J.matmul(W, J.matmul(H, Ht, bounded=True)), 2.0), E.scale(W, 2.0)])
    dH = J.add_many([E.scale(J.matmul(Wt, V), -2.0), E.scale(J.matmul(J.matmul(Wt, W, bounded=True), H), 2.0), E.scale(H, 2.0)])
    return vec_stack([vec(dW), vec(dH)])


def _cut(x: Vec) -> Vec:
    return Vec(cut_lineage(x.df), x.size)


def bfgs_step(B: Mat, g1: Vec, g2: Vec, scaled: bool = False) -> Mat:
    """``B <- B + y yᵀ - (B s)(sᵀ B)`` with ``s = -g1``, ``y = g2 - g1``.

    ``B s`` and ``sᵀ B`` are matrix-vector products (never ``s sᵀ``).  With
    ``scaled=True`` the textbook denominators ``yᵀ s`` and ``sᵀ B s`` are
    applied (ruling R15); the default follows the original as written.

    The gradients and the vectors made of them are used several times, so each
    is written once to the checkpoint folder.
    """
    g1, g2 = _cut(g1), _cut(g2)
    s = E.scale_vec(g1, -1.0)
    y = _cut(J.vec_subtract(g2, g1))
    Bs = _cut(J.matvec(B, s))
    sB = _cut(J.vecmat(s, B))
    a, b = 1.0, 1.0
    if scaled:
        ys = J.inner(y, s).first()[0]
        sBs = J.inner(s, Bs).first()[0]
        a, b = 1.0 / ys, 1.0 / sBs
    return J.low_rank_update(B, [(a, y, y), (-b, Bs, sB)])
