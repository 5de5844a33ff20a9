"""Aggregations.

Every aggregate is a partial + final hash aggregate (map-side combine), so a
hot row or column is reduced to one partial row per task before the shuffle.
Results that are scalars come back as one-row DataFrames; the ``*_value``
helpers pull that single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Mat, Vec, canon, cut_lineage, fits_broadcast, idiv, require


def row_sums(m: Mat) -> Vec:
    """A1: ``A 1`` as an ``nrows``-vector."""
    return Vec(canon(m.df.groupBy("i").agg(F.sum("v").alias("v"))), m.nrows)


def col_sums(m: Mat) -> Vec:
    """A1 on the transpose: ``1ᵀ A``."""
    out = m.df.groupBy(F.col("j").alias("i")).agg(F.sum("v").alias("v"))
    return Vec(canon(out), m.ncols)


def frobenius(m: Mat) -> DataFrame:
    """A2: ``sqrt(sum v^2)``."""
    return m.df.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("frobenius"))


def norm(x: Vec, p: float | str = 2) -> DataFrame:
    """A3: vector p-norm; ``p`` in {1, 2, 'inf'} or any positive number."""
    a = F.abs("v")
    if p == 1:
        e = F.sum(a)
    elif p == 2:
        e = F.sqrt(F.sum(a * a))
    elif p in ("inf", float("inf")):
        e = F.max(a)
    else:
        require(float(p) > 0, "p must be positive")
        e = F.pow(F.sum(F.pow(a, F.lit(float(p)))), F.lit(1.0 / float(p)))
    return x.df.agg(F.coalesce(e, F.lit(0.0)).alias("norm"))


def norms(x: Vec, p_general: float = 3.0) -> DataFrame:
    """A3: L1, L2, L-inf and a general p-norm in one pass."""
    a = F.abs("v")
    return x.df.agg(
        F.coalesce(F.sum(a), F.lit(0.0)).alias("l1"),
        F.coalesce(F.sqrt(F.sum(a * a)), F.lit(0.0)).alias("l2"),
        F.coalesce(F.max(a), F.lit(0.0)).alias("linf"),
        F.coalesce(F.pow(F.sum(F.pow(a, F.lit(p_general))), F.lit(1.0 / p_general)), F.lit(0.0)).alias("lp"),
    )


def nnz(m: Mat | Vec) -> DataFrame:
    """A4: stored entry count."""
    return m.df.agg(F.count(F.lit(1)).alias("nnz"))


def sparsity(m: Mat) -> DataFrame:
    """A5: ``nnz / (nrows * ncols)``."""
    cells = float(m.nrows) * float(m.ncols)
    return m.df.agg(
        F.count(F.lit(1)).alias("nnz"),
        (F.count(F.lit(1)) / F.lit(cells)).alias("sparsity"),
    )


def shape(m: Mat) -> DataFrame:
    """Inferred shape ``max index + 1`` next to the declared one."""
    return m.df.agg(
        F.coalesce(F.max("i") + 1, F.lit(0)).cast("long").alias("inferred_rows"),
        F.coalesce(F.max("j") + 1, F.lit(0)).cast("long").alias("inferred_cols"),
    ).select(
        F.lit(m.nrows).cast("long").alias("nrows"),
        F.lit(m.ncols).cast("long").alias("ncols"),
        "inferred_rows",
        "inferred_cols",
    )


def stat(m: Mat, rows_per_block: int, cols_per_block: int) -> DataFrame:
    """K3: shape, block grid, block size, stored blocks and nnz.

    Stored blocks are counted exactly: a group-by on the block key (partial
    aggregation leaves at most one row per block per task) and a global sum.
    """
    rb = -(-m.nrows // rows_per_block)
    cb = -(-m.ncols // cols_per_block)
    per_block = m.df.groupBy(
        idiv(F.col("i"), F.lit(rows_per_block)).alias("bi"),
        idiv(F.col("j"), F.lit(cols_per_block)).alias("bj"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_block.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("nnz"),
        F.count(F.lit(1)).alias("stored_blocks"),
    ).select(
        F.lit(m.nrows).cast("long").alias("nrows"),
        F.lit(m.ncols).cast("long").alias("ncols"),
        F.lit(rb).cast("long").alias("row_blocks"),
        F.lit(cb).cast("long").alias("col_blocks"),
        F.lit(rows_per_block).cast("long").alias("rows_per_block"),
        F.lit(cols_per_block).cast("long").alias("cols_per_block"),
        "nnz",
        "stored_blocks",
    )


def _sampled_blocks(nblocks: int, ratio: float) -> tuple[int, int]:
    n_sampled = max(int(ratio * nblocks), 1)
    step = max(nblocks // n_sampled, 1)
    return n_sampled, step


def block_nnz_sample(m: Mat, block: int, ratio: float, axis: str = "row") -> DataFrame:
    """Nnz of every ``step``-th row block (or column block).

    ``n_sampled = max(int(ratio * nblk), 1)``, ``step = nblk div n_sampled``;
    blocks ``0, step, 2*step, ...`` (``n_sampled`` of them) are counted.  The
    sample predicate is a filter before a partial aggregate, so only sampled
    entries are shuffled.
    """
    idx = "i" if axis == "row" else "j"
    dim = m.nrows if axis == "row" else m.ncols
    nblk = -(-dim // block)
    n_sampled, step = _sampled_blocks(nblk, ratio)
    b = idiv(F.col(idx), F.lit(block))
    keep = (F.pmod(b, F.lit(step)) == 0) & (idiv(b, F.lit(step)) < F.lit(n_sampled))
    return (
        m.df.filter(keep)
        .groupBy(b.alias("block"))
        .agg(F.count(F.lit(1)).alias("nnz"))
        .select(F.lit(axis).alias("axis"), "block", "nnz")
    )


def product_cost(a: Mat, b: Mat, block: int) -> DataFrame:
    """``sum_k nnz(A column block k) * nnz(B row block k)``.

    Two small count tables (one row per block) joined on the block id.
    """
    require(a.ncols == b.nrows, "inner dimensions differ")
    ca = a.df.groupBy(idiv(F.col("j"), F.lit(block)).alias("k")).agg(F.count(F.lit(1)).alias("na"))
    cb = b.df.groupBy(idiv(F.col("i"), F.lit(block)).alias("k")).agg(F.count(F.lit(1)).alias("nb"))
    return ca.join(cb, "k").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).cast("long").alias("cost"))


def product_cost_value(a: Mat, b: Mat, block: int) -> int:
    return int(product_cost(a, b, block).first()[0])


def out_degree_weights(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Weight ``1 / outdeg(src)`` per edge; duplicate edges count.

    Degrees are a partial aggregate, written and counted.  Where there are few sources they are
    broadcast and the edges stay where they are; else they are joined back by a shuffle that splits
    a hub source with a third of all edges.
    """
    from tessera.plans.skew import salted_join

    deg = cut_lineage(edges.groupBy(src).agg(F.count(F.lit(1)).alias("_deg")))
    if fits_broadcast(edges.sparkSession, deg.count()):
        j = edges.select(src, dst).join(F.broadcast(deg), src)
    else:
        j = salted_join(edges.select(src, dst), deg, [src], split_right=False)
    return j.select(src, dst, (F.lit(1.0) / F.col("_deg")).alias("w"))
