"""Joins and products.

Plans, in entry form:

* add / subtract: ``union`` then one group-by on ``(i, j)`` -- a single
  shuffle with map-side combine; keys are unique per side, so no skew.
* element-wise multiply / divide: inner join on ``(i, j)``; keys unique on
  both sides, so no skew.
* products: join on the inner index ``k`` and a group-by on ``(i, j)`` with
  partial aggregation.  The join side whose *declared shape* proves it small
  is broadcast (the big side is then streamed in place, never shuffled on
  ``k``); otherwise both sides are shuffled on ``k`` with hot ``k`` values
  split across tasks in two dimensions (:func:`tessera.plans.skew.salted_join`),
  or, when the counted partial products outweigh it, entries are dealt to blocks
  of the result and no partial product is shuffled (:func:`matmul_stationary`).
* matrix-vector: the vector (bounded by its size) is broadcast when it fits,
  else the matrix side's hot keys are split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import CONF_BROADCAST_ROWS, CONF_HOT_KEY_ROWS, Mat, Vec, canon, conf_int, cut_lineage, fits_broadcast, joins_in_place, require, ship_package
from tessera.operators.elementwise import transpose
from tessera.plans.blocks import SENT_ROWS, dealt_chain, dealt_product
from tessera.plans.generated import DenseCells, beside
from tessera.plans.skew import join_by_bound, salted_join


def _same_shape(a: Mat, b: Mat) -> None:
    require(a.shape == b.shape, f"shape mismatch {a.shape} vs {b.shape}")


# ---------------------------------------------------------------------------
# Element-wise
# ---------------------------------------------------------------------------


def add(a: Mat, b: Mat, every_cell: bool = False) -> Mat:
    """``A + B``; an absent entry on either side counts as 0.  ``every_cell`` states that B stores every cell of its shape and
    A each of its cells once: A's entries are then looked up where B's cells are, in a hash table of each partition."""
    _same_shape(a, b)
    if every_cell:
        near = a.df.select("i", "j", F.col("v").alias("av")).hint("shuffle_hash")
        sums = b.df.join(near, ["i", "j"], "left").select("i", "j", (F.col("v") + F.coalesce(F.col("av"), F.lit(0.0))).alias("v"))
        rest = a.entries().filter(F.col("i").isNull() | F.col("j").isNull())
        return Mat(canon(sums.unionByName(rest)), a.nrows, a.ncols, met=_meeting(a, b, True))
    u = a.entries().unionByName(b.entries())
    return Mat(canon(u.groupBy("i", "j").agg(F.sum("v").alias("v"))), a.nrows, a.ncols)


def add_many(mats: list[Mat]) -> Mat:
    """Sum of several matrices with one shuffle."""
    require(len(mats) > 0, "nothing to add")
    for m in mats[1:]:
        _same_shape(mats[0], m)
    u = mats[0].entries()
    for m in mats[1:]:
        u = u.unionByName(m.entries())
    return Mat(canon(u.groupBy("i", "j").agg(F.sum("v").alias("v"))), mats[0].nrows, mats[0].ncols)


def subtract(a: Mat, b: Mat) -> Mat:
    """``A - B`` (one shuffle: the negation is fused into the union)."""
    _same_shape(a, b)
    u = a.entries().unionByName(b.df.select("i", "j", (-F.col("v")).alias("v")))
    return Mat(canon(u.groupBy("i", "j").agg(F.sum("v").alias("v"))), a.nrows, a.ncols)


def elementwise_multiply(a: Mat, b: Mat) -> Mat:
    """Hadamard product; only cells stored on both sides survive."""
    _same_shape(a, b)
    j = a.df.select("i", "j", F.col("v").alias("av")).join(
        b.df.select("i", "j", F.col("v").alias("bv")), ["i", "j"], "inner"
    )
    return Mat(canon(j.select("i", "j", (F.col("av") * F.col("bv")).alias("v"))), a.nrows, a.ncols, met=_meeting(a, b, False))


@dataclass(frozen=True)
class Meeting:
    """A stored matrix and the generated one that it is added to or multiplied with."""

    stored: Mat
    cells: DenseCells
    add: bool


def _meeting(a: Mat, b: Mat, add: bool) -> Meeting | None:
    return Meeting(a, b.cells, add) if isinstance(b.cells, DenseCells) else None


def beside_stored(m: Mat, parts: int) -> DataFrame:
    """``(i, j, v, q)``: the cells of ``Q + R`` or of Q times R, for a generated R and a Q that stores each of its cells once, that Q
    stores, beside Q.  All of R's cells are drawn, in ``parts`` places where Q's entries are (:func:`tessera.plans.generated.beside`)."""
    met: Meeting = m.met
    require(met is not None, "not a sum or product with a generated matrix")
    return beside(met.stored.entries(), met.cells, met.add, parts)


def elementwise_divide(a: Mat, b: Mat) -> Mat:
    """``A / B`` where both sides are stored (ruling R22)."""
    _same_shape(a, b)
    j = a.df.select("i", "j", F.col("v").alias("av")).join(
        b.df.select("i", "j", F.col("v").alias("bv")), ["i", "j"], "inner"
    )
    return Mat(
        canon(j.select("i", "j", F.try_divide(F.col("av"), F.col("bv")).alias("v"))),
        a.nrows,
        a.ncols,
    )


def divide_vector(a: Mat, x: Vec) -> Mat:
    """Divide column ``j`` by ``x[j]``; an absent divisor gives 0 (dropped)."""
    require(x.size == a.ncols, "vector size must equal column count")
    d = x.df.select(F.col("i").alias("j"), F.col("v").alias("_d"))
    j = join_by_bound(a.df, d, ["j"], x.size)
    return Mat(canon(j.select("i", "j", F.try_divide(F.col("v"), F.col("_d")).alias("v"))), a.nrows, a.ncols)


# ---------------------------------------------------------------------------
# Matrix products
# ---------------------------------------------------------------------------


def product_terms(
    a: Mat,
    b: Mat,
    strategy: str = "auto",
    transpose_pair: bool = False,
    bounded: bool = False,
    counts: tuple[int, int] | None = None,
) -> DataFrame:
    """Joined partial products ``(i, j, p)`` of ``A @ B`` before aggregation.

    ``strategy``: ``auto`` (broadcast a side proven small by its shape, else
    skew-split shuffle), ``broadcast`` (J7, the side of fewer entries, in parts where it does not fit),
    ``shuffle`` (force the skew-split shuffle join).  ``transpose_pair``
    states ``b = aᵀ``, so hot inner indices are counted once.  ``bounded``
    states that no inner index has many entries on either side (a factor's
    few columns), so a shuffled join needs no count and no split.  ``counts`` are the
    stored entries of both sides where they were counted: ``auto`` broadcasts the side of fewer entries if these
    fit, and the other side stays where it is.
    """
    require(a.ncols == b.nrows, f"inner dimensions differ: {a.shape} @ {b.shape}")
    spark = a.spark
    A = a.df.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    B = b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("bv"))
    fa, fb = fits_broadcast(spark, a.cell_bound), fits_broadcast(spark, b.cell_bound)
    if strategy == "broadcast" and not (fa or fb):
        return _broadcast_parts(A, B)
    if strategy != "shuffle" and (fa or fb):
        if fb and (not fa or b.cell_bound <= a.cell_bound):
            joined = A.join(F.broadcast(B), "k")
        else:
            joined = F.broadcast(A).join(B, "k")
    elif bounded:
        joined = A.join(B, "k")
    elif strategy == "auto" and counts is not None and fits_broadcast(spark, min(counts)):
        joined = A.join(F.broadcast(B), "k") if counts[1] <= counts[0] else F.broadcast(A).join(B, "k")
    else:
        joined = salted_join(A, B, ["k"], same_key_counts=transpose_pair)
    return joined.select("i", "j", (F.col("av") * F.col("bv")).alias("p"))


def _broadcast_parts(A: DataFrame, B: DataFrame) -> DataFrame:
    """Partial products with the side of fewer counted entries broadcast, in parts of about the broadcast limit; every part
    meets the whole other side in place."""
    na, nb = A.count(), B.count()
    small, large = (A, B) if na < nb else (B, A)
    parts = max(1, -(-min(na, nb) // max(1, conf_int(A.sparkSession, CONF_BROADCAST_ROWS))))
    part = F.pmod(F.xxhash64(*small.columns), F.lit(parts))
    met = [large.join(F.broadcast(small.filter(part == n) if parts > 1 else small), "k") for n in range(parts)]
    return reduce(DataFrame.unionByName, met).select("i", "j", (F.col("av") * F.col("bv")).alias("p"))


def matmul(a: Mat, b: Mat, strategy: str = "auto", bounded: bool = False) -> Mat:
    """``A @ B`` = join on k, partial-aggregated sum by (i, j).

    ``strategy="stationary"`` deals both sides to blocks of the result
    (:func:`matmul_stationary`); ``auto`` does so where neither side fits a broadcast, or the product's cells are many, and the
    counts say that less is shuffled (:class:`ProductCost`), ``shuffle`` where the products are many besides.  Where B is a dealt product
itself, ``auto`` forms ``A B`` in the places where B's cells are formed (:func:`_chained`)."""
    if strategy == "stationary":
        return matmul_stationary(a, b)
    if strategy == "auto" and not bounded and b.factors is not None:
        chained = _chained(a, b)
        if chained is not None:
            return chained
    small = [fits_broadcast(a.spark, m.cell_bound) for m in (a, b)]
    # Two small matrices may have a large product, and few partitions; one small matrix may have a product of many cells, whose
    # sums would all be shuffled.
    many = (all(small) and a.cell_bound * b.ncols > PRODUCTS_A_TASK) or (any(small) and a.nrows * b.ncols > PRODUCTS_A_TASK)
    counts = None
    if strategy in ("auto", "shuffle") and not bounded and (strategy == "shuffle" or many or not any(small)):
        a, b = _written(a), _written(b)
        cost = product_counts(a, b)
        if cost.prefers_stationary and (cost.deals_packed or not (many or strategy == "shuffle")):
            return matmul_stationary(a, b, cost)
        counts = cost.left, cost.right
    t = product_terms(a, b, strategy, bounded=bounded, counts=counts)
    out = t.groupBy("i", "j").agg(F.sum("p").alias("v"))
    return Mat(canon(out), a.nrows, b.ncols, formed=True)


def _written(m: Mat) -> Mat:
    """A product in the checkpoint folder, to be read several times; any other matrix as it is."""
    return Mat(cut_lineage(m.df), m.nrows, m.ncols) if m.formed else m


@dataclass(frozen=True)
class Factors:
    """What a dealt product is made of: ``F1 (F2 (... Fn))``, the stored entries of each, and the innermost product's terms."""

    mats: tuple[Mat, ...]
    counts: tuple[int, ...]
    products: int


def _chained(a: Mat, b: Mat) -> Mat | None:
    """``A B`` of a dealt product B, formed where B's cells are (:func:`tessera.plans.blocks.dealt_chain`), so that these are neither
    written nor shuffled; None if a place cannot hold its share of the factors, or the result has far more cells than B has terms."""
    require(a.ncols == b.nrows, f"inner dimensions differ: {a.shape} @ {b.shape}")
    f: Factors = b.factors
    if a.nrows * b.ncols > 16 * f.products or sum(f.counts[1:-1]) > PLACE_ENTRIES // 4:
        return None
    a = _written(a)
    counts = (a.df.count(), *f.counts)
    rows = max(1, math.ceil(2 * (counts[0] + counts[1]) / PLACE_ENTRIES))
    if rows > 1:
        widest = [m.df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).select("n") for m, c in ((a, "j"), (f.mats[0], "i"))]
        if (reduce(DataFrame.unionByName, widest).agg(F.max("n")).first()[0] or 0) > PLACE_ENTRIES // 4:
            return None
    places = max(2 * a.spark.sparkContext.defaultParallelism, math.ceil(f.products / CHAIN_PRODUCTS))
    cols = max(math.ceil(places / rows), math.ceil(4 * counts[-1] / PLACE_ENTRIES))
    mats = (a, *f.mats)
    return Mat(dealt_chain([m.entries() for m in mats], (rows, cols)), a.nrows, b.ncols, formed=True, factors=Factors(mats, counts, f.products))


CHAIN_PRODUCTS = 1 << 31  # terms of the innermost product of a chain that a place forms, about
PRODUCTS_A_TASK = 1 << 26  # partial products of a block of the result, about
UPDATE_CELLS = 1 << 24  # updates of more cells are dealt to blocks
CELLS_A_TERM = 16  # cells that are added to in the time of a partial product, about
PLACE_ENTRIES = 1 << 24  # stored entries that a place of the dealt product holds, about


@dataclass(frozen=True)
class ProductCost:
    """Counts of a product and the grid of result blocks that moves the fewest entries."""

    left: int  # stored entries
    right: int
    products: int
    widest: int  # entries of A's fullest row or B's fullest column
    hot: int  # a row or column of more entries counts as hot
    session: int  # shuffle partitions
    cores: int = 1

    @property
    def tasks(self) -> int:
        return max(self.session, math.ceil(self.products / PRODUCTS_A_TASK))

    @property
    def grid(self) -> tuple[int, int]:
        """Row blocks and column blocks: A is sent once a column block, B once a row block."""
        cols = min(self.tasks, max(1, round(math.sqrt(self.tasks * max(1, self.right) / max(1, self.left)))))
        return max(1, round(self.tasks / cols)), cols

    @property
    def moved(self) -> int:
        rows, cols = self.grid
        return self.left * cols + self.right * rows

    @property
    def deals_packed(self) -> bool:
        """So many products that forming them row by row, and spilling their sums, costs more than packing the entries."""
        return self.products > PRODUCTS_A_TASK

    @property
    def places(self) -> tuple[int, int]:
        """The grid of the dealt product (:mod:`tessera.plans.blocks`): as few places as the products and the entries a place
        holds allow, since each one more is sent more copies."""
        left, right = max(1, self.left), max(1, self.right)
        places = max(2 * self.cores, math.ceil(self.products / PRODUCTS_A_TASK))
        while True:
            cols = min(places, max(1, round(math.sqrt(places * right / left))))
            rows = math.ceil(places / cols)
            if left / rows + right / cols <= PLACE_ENTRIES:
                return rows, cols
            places *= 2

    @property
    def prefers_stationary(self) -> bool:
        """Dealing moves less than half of the products (less than twice of them where entries are packed, which are far smaller
        than a product's row), and no block of rows or columns is mostly one hot row or column."""
        if self.deals_packed:
            rows, cols = self.places
            return self.widest <= max(self.hot, PLACE_ENTRIES // 4) and self.left * cols + self.right * rows < 2 * self.products
        return self.widest <= self.hot and 2 * self.moved < self.products


def product_counts(a: Mat, b: Mat) -> ProductCost:
    """Counts per inner index, and per row of A and column of B: two aggregates, one row each reaches the driver."""
    require(a.ncols == b.nrows, f"inner dimensions differ: {a.shape} @ {b.shape}")
    spark = a.spark
    count = lambda m, c, name: m.df.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias(name))
    both = count(a, "j", "na").join(count(b, "i", "nb"), "k", "full")
    total = both.agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in (("l", F.col("na")), ("r", F.col("nb")), ("p", F.col("na") * F.col("nb")))]).first()
    widest = count(a, "i", "n").select("n").unionByName(count(b, "j", "n").select("n")).agg(F.max("n")).first()[0]
    return ProductCost(total["l"], total["r"], total["p"], widest or 0, conf_int(spark, CONF_HOT_KEY_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def matmul_stationary(a: Mat, b: Mat, cost: ProductCost | None = None) -> Mat:
    """J6, output-stationary: rows of A and columns of B are dealt by hash to blocks, every
    (row block, column block) is one place of the result, A's entries are sent to the places of
    their row block and B's to those of their column block.  Join and sum then
    happen where the entries are, so no partial product is shuffled.

    An inner index that a third of all entries share is spread over all places, as its
    entries lie in all row and column blocks.  A hot row of A or column of B is not, so
    ``auto`` leaves such products to the salted join.

    Products of more than ``PRODUCTS_A_TASK`` terms are dealt as packed entries and formed in
    numpy (:func:`tessera.plans.blocks.dealt_product`) whenever they are read, smaller ones joined row by row.  These are written to
    the checkpoint folder at once: that a join may use a partitioning on part of its keys is a session setting, which holds for
    this one plan only.
    """
    cost = cost or product_counts(a, b)
    if cost.deals_packed:
        return Mat(packed_product(a, b, cost), a.nrows, b.ncols, formed=True, factors=Factors((a, b), (cost.left, cost.right), cost.products))
    with joins_in_place(a.spark):
        return Mat(cut_lineage(stationary_plan(a, b, cost)), a.nrows, b.ncols)


def packed_product(a: Mat, b: Mat, cost: ProductCost, outer: tuple[DataFrame, DataFrame] | None = None, count: bool = False) -> DataFrame:
    """:func:`tessera.plans.blocks.dealt_product` of two matrices."""
    left, right = a.df.select("i", F.col("j").alias("k"), "v"), b.df.select(F.col("i").alias("k"), "j", "v")
    return dealt_product(left, right, cost.places, outer=outer, count=count)


def stored_cells(m: Mat) -> DataFrame:
    """One row ``(nnz)``: how many cells m stores.  A dealt product's are formed and counted in their places, so that none of them
    is a row."""
    f: Factors | None = m.factors
    if f is None or len(f.mats) != 2:
        return m.df.agg(F.count(F.lit(1)).alias("nnz"))
    cost = ProductCost(*f.counts, f.products, 0, 0, 1, m.spark.sparkContext.defaultParallelism)
    return packed_product(*f.mats, cost, count=True).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"))


def stationary_plan(a: Mat, b: Mat, cost: ProductCost) -> DataFrame:
    """The plan of :func:`matmul_stationary`: two shuffles, then join and sum in place."""
    rows, cols = cost.grid
    parts = max(1, min(cost.tasks, rows * cols))
    ids = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    A = a.df.select("i", F.col("j").alias("k"), F.col("v").alias("av"), F.pmod(F.xxhash64("i"), F.lit(rows)).alias("_r"), ids(cols).alias("_c"))
    B = b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("bv"), F.pmod(F.xxhash64("j"), F.lit(cols)).alias("_c"), ids(rows).alias("_r"))
    # Both sides have one partitioning on (_r, _c), which serves the join and the sum.
    joined = A.repartition(parts, "_r", "_c").join(B.repartition(parts, "_r", "_c"), ["_r", "_c", "k"])
    out = joined.groupBy("_r", "_c", "i", "j").agg(F.sum(F.col("av") * F.col("bv")).alias("v"))
    return canon(out.select("i", "j", "v"))


def gram(a: Mat, strategy: str = "auto") -> Mat:
    """``A Aᵀ`` using symmetry: only pairs with ``i <= i'`` are joined and
    aggregated (about half the partial products), and the strict upper
    triangle is mirrored in the same projection (``explode`` of one or two
    cells per row), so the join is computed once.  Products of more than ``PRODUCTS_A_TASK`` terms are dealt to the places on and
    above the diagonal of a square grid (:func:`tessera.plans.blocks.dealt_product`)."""
    if strategy != "broadcast" and a.cell_bound * a.nrows > PRODUCTS_A_TASK:
        cost = product_counts(a, transpose(a))
        if cost.deals_packed and cost.prefers_stationary:
            rows = a.df.filter(F.col("i").isNotNull())  # as the comparison of the indices does below
            left, right = rows.select("i", F.col("j").alias("k"), "v"), rows.select(F.col("j").alias("k"), F.col("i").alias("j"), "v")
            side = math.ceil(math.sqrt(2 * math.prod(cost.places)))  # half of the places are formed
            return Mat(dealt_product(left, right, (side, side), half=True), a.nrows, a.nrows, formed=True)
    t = product_terms(a, transpose(a), strategy, transpose_pair=True).filter(F.col("i") <= F.col("j"))
    up = t.groupBy("i", "j").agg(F.sum("p").alias("v"))
    cells = F.when(
        F.col("i") < F.col("j"),
        F.array(F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v")),
    ).otherwise(F.array(F.struct("i", "j", "v")))
    out = up.select(F.explode(cells).alias("c")).select("c.i", "c.j", "c.v")
    return Mat(canon(out), a.nrows, a.nrows)


def matmul_broadcast(a: Mat, b: Mat) -> Mat:
    """Product with one side replicated (checked against its shape)."""
    return matmul(a, b, strategy="broadcast")


def matmul_outer(a: Mat, b: Mat) -> Mat:
    """Outer-product form (few inner indices).  A one-value join key is
    never shuffled: the smaller side is broadcast when it fits, else the hot
    key is split in two dimensions by the salted join."""
    return matmul(a, b, strategy="auto")


# Row-layout x column-layout (J12) and column x row (J13) are the same table
# plan in entry form.
multiply_row_by_column = matmul
multiply_column_by_row = matmul


# ---------------------------------------------------------------------------
# Matrix-vector
# ---------------------------------------------------------------------------


def matvec(a: Mat, x: Vec) -> Vec:
    """``A x``."""
    require(a.ncols == x.size, "size mismatch in A @ x")
    xs = x.df.select(F.col("i").alias("j"), F.col("v").alias("xv"))
    j = join_by_bound(a.df, xs, ["j"], x.size)
    out = j.groupBy("i").agg(F.sum(F.col("v") * F.col("xv")).alias("v"))
    return Vec(canon(out), a.nrows)


def vecmat(x: Vec, a: Mat) -> Vec:
    """``xᵀ A`` as a vector over A's columns."""
    require(a.nrows == x.size, "size mismatch in x @ A")
    xs = x.df.select("i", F.col("v").alias("xv"))
    j = join_by_bound(a.df, xs, ["i"], x.size)
    out = j.groupBy("j").agg(F.sum(F.col("v") * F.col("xv")).alias("v"))
    return Vec(canon(out.withColumnRenamed("j", "i")), a.ncols)


# ---------------------------------------------------------------------------
# Vector products, fused forms
# ---------------------------------------------------------------------------


OUTER_BLOCK = 4096  # stored entries of a block, about
MOST_PAIR_TASKS = 2000


def _outer_blocks(x: Vec, names: tuple[str, str, str, str]) -> tuple[DataFrame, int, int]:
    """``(block, entries)``: x's stored entries dealt by hash to blocks of about ``OUTER_BLOCK``; and the numbers of blocks and entries."""
    block, entries, index, value = names
    n = x.df.count()
    blocks = max(1, -(-n // OUTER_BLOCK))
    dealt = x.df.groupBy(F.pmod(F.xxhash64("i"), F.lit(blocks)).alias(block))
    return dealt.agg(F.collect_list(F.struct(F.col("i").alias(index), F.col("v").alias(value))).alias(entries)), blocks, n


def outer_product(x: Vec, y: Vec) -> Mat:
    """``x yᵀ`` (an ``x.size x y.size`` result).

    Both vectors' stored entries are counted and dealt to blocks, so blocks follow
    the entries whatever the declared sizes.  Every block of x is repeated for y's block
    numbers, meets y's blocks by an equi-join, and a pair of blocks is expanded in
    place by numpy: ``nnz(x) * nnz(y)`` cells and no other row but one per pair of blocks.
    y's blocks are broadcast when the counted entries fit, else both sides are
    shuffled; every block number has as many rows as any other.  Pairs are spread over the
    tasks before they are expanded, since a few small rows would be left to one task.
    No cross product is planned.
    """
    ship_package(x.spark)
    xs, blocks_x, _ = _outer_blocks(x, ("_a", "_xs", "i", "xv"))
    ys, blocks, n_y = _outer_blocks(y, ("_b", "_ys", "j", "yv"))
    ids = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    pairs = xs.select("_a", "_xs", F.explode(ids).alias("_b"))
    pairs = pairs.repartition(min(blocks_x * blocks, MOST_PAIR_TASKS), "_a", "_b")
    pairs = pairs.join(F.broadcast(ys) if fits_broadcast(x.spark, n_y) else ys, "_b")
    blocks_met = pairs.select("_xs.i", "_xs.xv", "_ys.j", "_ys.yv")
    return Mat(blocks_met.mapInArrow(_outer_cells, "i long, j long, v double"), x.size, y.size)


def _outer_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of pairs of blocks, zeros and NaN left out, ``SENT_ROWS`` or one row of the block at a time."""
    for batch in batches:
        for n in range(batch.num_rows):
            i, xv, j, yv = (batch.column(c)[n].values for c in ("i", "xv", "j", "yv"))
            xs, ys = (v.fill_null(math.nan).to_numpy(zero_copy_only=False) for v in (xv, yv))
            height = max(1, SENT_ROWS // max(1, len(ys)))
            columns = np.tile(np.arange(len(ys)), height)
            for top in range(0, len(xs), height):
                part = xs[top : top + height]
                with np.errstate(all="ignore"):
                    v = np.multiply.outer(part, ys).ravel()
                rows, at = np.repeat(np.arange(top, top + len(part)), len(ys)), columns[: len(v)]
                kept = (v != 0) & ~np.isnan(v)
                if not kept.all():
                    rows, at, v = rows[kept], at[kept], v[kept]
                yield pa.RecordBatch.from_arrays([i.take(pa.array(rows)), j.take(pa.array(at)), pa.array(v)], names=["i", "j", "v"])


def rank_one_update(a: Mat, x: Vec, alpha: float = 1.0) -> Mat:
    """``A + alpha x xᵀ`` over all cells (ruling R2)."""
    require(a.nrows == a.ncols == x.size, "rank-one update needs a square A of x's size")
    return low_rank_update(a, [(alpha, x, x)])


def low_rank_update(a: Mat, terms: list[tuple[float, Vec, Vec]]) -> Mat:
    """``A + sum of alpha x yᵀ`` over all cells.  Updates of more than ``UPDATE_CELLS`` cells are added where A's cells are formed
    if A is a dealt product, which is not written then; formed where A's entries are if A is counted to store every cell; else dealt
    to blocks of the result: A's entries are moved once at most and the outer products' cells never."""
    if a.cell_bound > UPDATE_CELLS:
        pack = lambda n, v, name, alpha: v.df.select(F.col("i").alias(name), F.lit(n).cast("long").alias("k"), (F.col("v") * F.lit(float(alpha))).alias("v"))
        left = reduce(DataFrame.unionByName, [pack(n, x, "i", alpha) for n, (alpha, x, _) in enumerate(terms)])
        right = reduce(DataFrame.unionByName, [pack(n, y, "j", 1.0) for n, (_, _, y) in enumerate(terms)])
        f: Factors | None = a.factors
        if f is not None and len(f.mats) == 2 and all(fits_broadcast(a.spark, v.size) for _, x, y in terms for v in (x, y)):
            cost = ProductCost(*f.counts, max(f.products, a.cell_bound // CELLS_A_TERM), 0, 0, 1, a.spark.sparkContext.defaultParallelism)
            return Mat(packed_product(*f.mats, cost, (left, right)), a.nrows, a.ncols)
        a = _written(a)
        if _updates_in_place(a, terms):
            return Mat(_updated_cells(a, terms), a.nrows, a.ncols)
        n_left, n_right, n_a = left.count(), right.count(), a.df.count()
        cost = ProductCost(n_left, n_right, max(n_a, n_left * n_right), 0, 0, 1, a.spark.sparkContext.defaultParallelism)
        return Mat(dealt_product(left, right, cost.places, a.entries()), a.nrows, a.ncols)
    u = a.entries()
    for alpha, x, y in terms:
        m = outer_product(x, y)
        u = u.unionByName(m.df.select("i", "j", (F.col("v") * F.lit(float(alpha))).alias("v")))
    return Mat(canon(u.groupBy("i", "j").agg(F.sum("v").alias("v"))), a.nrows, a.ncols)


def _updates_in_place(a: Mat, terms: list[tuple[float, Vec, Vec]]) -> bool:
    """Whether the vectors fit a broadcast and have no NULL index, and A stores every cell, so that no cell is left to the
    outer products alone."""
    vectors = [v for _, x, y in terms for v in (x, y)]
    if not all(fits_broadcast(a.spark, v.size) for v in vectors):
        return False
    if reduce(DataFrame.unionByName, [v.df.select("i") for v in vectors]).filter(F.col("i").isNull()).count():
        return False
    return a.df.filter(F.col("i").isNotNull() & F.col("j").isNotNull()).count() == a.cell_bound


def _updated_cells(a: Mat, terms: list[tuple[float, Vec, Vec]]) -> DataFrame:
    """A's cells, each with the products of its row's and its column's values added; the vectors are broadcast."""

    def wide(vectors: list[tuple[float, Vec]], index: str, name: str) -> DataFrame:
        each = [v.df.select(F.col("i").alias(index), F.lit(n).alias("_n"), (F.col("v") * F.lit(float(alpha))).alias("_v")) for n, (alpha, v) in enumerate(vectors)]
        values = [F.sum(F.when(F.col("_n") == n, F.col("_v"))).alias(f"{name}{n}") for n in range(len(vectors))]
        return F.broadcast(reduce(DataFrame.unionByName, each).groupBy(index).agg(*values))

    xs, ys = wide([(alpha, x) for alpha, x, _ in terms], "i", "_x"), wide([(1.0, y) for _, _, y in terms], "j", "_y")
    v = F.col("v")
    for n in range(len(terms)):
        v = v + F.coalesce(F.col(f"_x{n}") * F.col(f"_y{n}"), F.lit(0.0))
    return canon(a.df.join(xs, "i", "left").join(ys, "j", "left").select("i", "j", v.alias("v")))


def vec_add(x: Vec, y: Vec) -> Vec:
    """``x + y``."""
    require(x.size == y.size, "vector sizes differ")
    u = x.entries().unionByName(y.entries())
    return Vec(canon(u.groupBy("i").agg(F.sum("v").alias("v"))), x.size)


def axpy(alpha: float, x: Vec, y: Vec) -> Vec:
    """``alpha x + y`` in one shuffle."""
    require(x.size == y.size, "vector sizes differ")
    u = x.df.select("i", (F.col("v") * F.lit(float(alpha))).alias("v")).unionByName(y.entries())
    return Vec(canon(u.groupBy("i").agg(F.sum("v").alias("v"))), x.size)


def vec_subtract(x: Vec, y: Vec) -> Vec:
    return axpy(-1.0, y, x)


def inner(x: Vec, y: Vec) -> DataFrame:
    """``x · y`` as a one-row DataFrame ``(v)`` (ruling R1: both values).

    Keys are unique on both sides, so the join on ``i`` cannot be skewed.
    """
    require(x.size == y.size, "vector sizes differ")
    j = x.df.select("i", F.col("v").alias("xv")).join(y.df.select("i", F.col("v").alias("yv")), "i")
    return j.agg(F.coalesce(F.sum(F.col("xv") * F.col("yv")), F.lit(0.0)).alias("v"))


def gemm(alpha: float, a: Mat, b: Mat, beta: float = 0.0, c: Mat | None = None) -> Mat:
    """``alpha A B + beta C`` fused: the scaled C entries join the partial
    products before the single group-by (ruling R25: C has A's rows).

    Where neither A nor B fits a broadcast by its shape they are counted: a large product is dealt to places as packed entries, C's
    with it (:func:`tessera.plans.blocks.dealt_product`), else the side of fewer entries is broadcast if these fit."""
    require(a.ncols == b.nrows, f"inner dimensions differ: {a.shape} @ {b.shape}")
    added = None
    if c is not None and beta != 0.0:
        require(c.shape == (a.nrows, b.ncols), "C must have shape (A.nrows, B.ncols)")
        added = c.df.select("i", "j", (F.col("v") * F.lit(float(beta))).alias("v"))
    counts = None
    if not any(fits_broadcast(a.spark, m.cell_bound) for m in (a, b)):
        a, b = _written(a), _written(b)
        cost = product_counts(a, b)
        counts = cost.left, cost.right
        if cost.deals_packed and cost.prefers_stationary:
            left = a.df.select("i", F.col("j").alias("k"), (F.col("v") * F.lit(float(alpha))).alias("v"))
            right = b.df.select(F.col("i").alias("k"), "j", "v")
            return Mat(dealt_product(left, right, cost.places, added), a.nrows, b.ncols, formed=True)
    terms = product_terms(a, b, counts=counts).select("i", "j", (F.col("p") * F.lit(float(alpha))).alias("v"))
    if added is not None:
        terms = terms.unionByName(added)
    return Mat(canon(terms.groupBy("i", "j").agg(F.sum("v").alias("v"))), a.nrows, b.ncols)


def gemv(alpha: float, a: Mat, x: Vec, beta: float = 0.0, y: Vec | None = None) -> Vec:
    """``alpha A x + beta y`` with one final group-by."""
    require(a.ncols == x.size, "size mismatch in A @ x")
    xs = x.df.select(F.col("i").alias("j"), F.col("v").alias("xv"))
    j = join_by_bound(a.df, xs, ["j"], x.size)
    terms = j.select("i", (F.col("v") * F.col("xv") * F.lit(float(alpha))).alias("v"))
    if y is not None and beta != 0.0:
        require(y.size == a.nrows, "y must have A's row count")
        terms = terms.unionByName(y.df.select("i", (F.col("v") * F.lit(float(beta))).alias("v")))
    return Vec(canon(terms.groupBy("i").agg(F.sum("v").alias("v"))), a.nrows)
