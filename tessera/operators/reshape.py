"""Reshape and layout.

Reshapes are index arithmetic in a projection (no shuffle).  Layout
operators return the same canonical entries with a chosen physical
partitioning, so a following join or aggregate on the same key reuses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import Mat, Vec, canon, idiv, require


def grid(spark: SparkSession, nrows: int, ncols: int) -> DataFrame:
    """Every cell ``(i, j)`` of a shape, generated in parallel by ``spark.range``."""
    return spark.range(nrows * ncols).select(
        (F.col("id") % F.lit(nrows)).alias("i"), idiv(F.col("id"), F.lit(nrows)).alias("j")
    )


def vec(m: Mat) -> Vec:
    """Stack columns into an ``(m*n)``-vector, index ``j*nrows + i``."""
    df = m.df.select((F.col("j") * F.lit(m.nrows) + F.col("i")).alias("i"), "v")
    return Vec(df, m.nrows * m.ncols)


def unvec(x: Vec, nrows: int, ncols: int) -> Mat:
    """Inverse of X1."""
    require(x.size == nrows * ncols, "size must be nrows*ncols")
    df = x.df.select(
        (F.col("i") % F.lit(nrows)).alias("i"), idiv(F.col("i"), F.lit(nrows)).alias("j"), "v"
    )
    return Mat(df, nrows, ncols)


def densify(m: Mat) -> Mat:
    """Every cell stored; absent cells become explicit 0.0 (dense result).

    The grid is generated by ``spark.range`` and left-joined on ``(i, j)``,
    where keys are unique on both sides.
    """
    g = grid(m.spark, m.nrows, m.ncols)
    df = g.join(m.df, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
    return Mat(df, m.nrows, m.ncols, dense=True)


def sparsify(m: Mat) -> Mat:
    """X3 inverse: drop explicit zeros."""
    return Mat(canon(m.df), m.nrows, m.ncols)


def hconcat(mats: list[Mat]) -> Mat:
    """``[A B ...]`` (equal row counts): column offsets, one union."""
    require(len(mats) > 0, "nothing to concatenate")
    nrows = mats[0].nrows
    out, off = None, 0
    for m in mats:
        require(m.nrows == nrows, "row counts differ")
        part = m.df.select("i", (F.col("j") + F.lit(off)).alias("j"), "v")
        out = part if out is None else out.unionByName(part)
        off += m.ncols
    return Mat(out, nrows, off)


def vconcat(mats: list[Mat]) -> Mat:
    """``[A; B; ...]`` (equal column counts): row offsets, one union."""
    require(len(mats) > 0, "nothing to concatenate")
    ncols = mats[0].ncols
    out, off = None, 0
    for m in mats:
        require(m.ncols == ncols, "column counts differ")
        part = m.df.select((F.col("i") + F.lit(off)).alias("i"), "j", "v")
        out = part if out is None else out.unionByName(part)
        off += m.nrows
    return Mat(out, off, ncols)


def vec_stack(vs: list[Vec]) -> Vec:
    """Stack vectors, each shifted by the sizes before it (ruling R14)."""
    out, off = None, 0
    for x in vs:
        part = x.df.select((F.col("i") + F.lit(off)).alias("i"), "v")
        out = part if out is None else out.unionByName(part)
        off += x.size
    return Vec(out, off)


def partition_by_row(m: Mat, n: int) -> Mat:
    """Hash-partition entries by row index."""
    return Mat(m.df.repartition(n, "i"), m.nrows, m.ncols, m.dense)


def partition_by_column(m: Mat, n: int) -> Mat:
    """Hash-partition entries by column index."""
    return Mat(m.df.repartition(n, "j"), m.nrows, m.ncols, m.dense)


def range_partition(m: Mat, n: int, by: str = "i") -> Mat:
    """Range partition on the row (or column) index, balanced by entry count
    from Spark's sampled bounds; the other index is a secondary key, so one
    long row is split too."""
    other = "j" if by == "i" else "i"
    return Mat(m.df.repartitionByRange(n, by, other), m.nrows, m.ncols, m.dense)


def partition_by_expression(m: Mat, n: int, pid) -> Mat:
    """user partitioner -- ``pid`` is a Column expression over ``i``/``j``
    giving the target partition in ``[0, n)``."""
    return Mat(m.df.repartitionById(n, pid.cast("int")), m.nrows, m.ncols, m.dense)


def repartition(m: Mat, n: int) -> Mat:
    """X11: round-robin repartition."""
    return Mat(m.df.repartition(n), m.nrows, m.ncols, m.dense)


def persist(m: Mat) -> Mat:
    """X11: cache the entry table (memory and disk)."""
    from pyspark import StorageLevel

    return Mat(m.df.persist(StorageLevel.MEMORY_AND_DISK), m.nrows, m.ncols, m.dense)
