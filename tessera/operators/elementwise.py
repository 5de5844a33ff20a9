"""Element-wise scalar operators, transpose, lookup, row normalisation.

All of these are narrow projections or filters over the entry table: no
shuffle, one whole-stage-codegen span, and they keep the input partitioning
(except transpose, which swaps the key columns).  Scalar add/power touch stored
entries only; absent entries stay 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import Mat, Vec, canon, require
from tessera.plans.skew import join_by_bound


def _mat(m: Mat, v: Column, keep_zero: bool = False) -> Mat:
    df = m.df.select("i", "j", v.cast("double").alias("v"))
    return Mat(df if keep_zero else canon(df), m.nrows, m.ncols, m.dense)


def scale(m: Mat, alpha: float) -> Mat:
    """``alpha * A``."""
    if alpha == 0.0:
        return Mat(m.df.limit(0), m.nrows, m.ncols)
    return _mat(m, F.col("v") * F.lit(float(alpha)))


def scale_vec(x: Vec, alpha: float) -> Vec:
    """E1 for vectors."""
    df = x.df.select("i", (F.col("v") * F.lit(float(alpha))).alias("v"))
    return Vec(canon(df), x.size)


def divide_scalar(m: Mat, alpha: float) -> Mat:
    """``A / alpha``; alpha must be non-zero."""
    require(alpha != 0.0, "division by zero scalar")
    return _mat(m, F.col("v") / F.lit(float(alpha)))


def divide_vec_scalar(x: Vec, alpha: float) -> Vec:
    require(alpha != 0.0, "division by zero scalar")
    return Vec(canon(x.df.select("i", (F.col("v") / F.lit(float(alpha))).alias("v"))), x.size)


def reciprocal(m: Mat, alpha: float = 1.0) -> Mat:
    """``alpha / x`` on stored entries (absent entries stay absent)."""
    return _mat(m, F.lit(float(alpha)) / F.col("v"))


def reciprocal_vec(x: Vec, alpha: float = 1.0) -> Vec:
    return Vec(canon(x.df.select("i", (F.lit(float(alpha)) / F.col("v")).alias("v"))), x.size)


def add_scalar(m: Mat, alpha: float) -> Mat:
    """``x + alpha`` on stored entries; an entry that becomes 0 is dropped."""
    return _mat(m, F.col("v") + F.lit(float(alpha)))


def power(m: Mat, p: float) -> Mat:
    """E5: ``x ^ p`` on stored entries."""
    return _mat(m, F.pow(F.col("v"), F.lit(float(p))))


def map_values(m: Mat, f: Callable[[Column], Column]) -> Mat:
    """Apply a Column expression to stored values (stays JVM-side)."""
    return _mat(m, f(F.col("v")))


def equals_indicator(m: Mat, c: float, tol: float = 1e-6) -> Mat:
    """1.0 where ``|x - c| < tol``.

    For ``|c| >= tol`` only stored entries can match (a filter).  For ``c``
    within ``tol`` of 0 every absent cell matches too, so the result is dense:
    absent cells are generated with ``spark.range`` and found with an
    anti-join, never with a cross product.
    """
    hit = m.df.filter(F.abs(F.col("v") - F.lit(float(c))) < F.lit(tol)).select(
        "i", "j", F.lit(1.0).alias("v")
    )
    if abs(c) >= tol:
        return Mat(hit, m.nrows, m.ncols)
    from tessera.operators.reshape import grid

    cells = grid(m.spark, m.nrows, m.ncols)
    absent = cells.join(m.df.select("i", "j"), ["i", "j"], "left_anti").withColumn("v", F.lit(1.0))
    return Mat(hit.unionByName(absent), m.nrows, m.ncols, dense=True)


def transpose(m: Mat) -> Mat:
    """Swap the index columns (no shuffle)."""
    df = m.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return Mat(df, m.ncols, m.nrows, m.dense)


def lookup(m: Mat, i: int, j: int) -> DataFrame:
    """Value at ``(i, j)`` as a one-row DataFrame; absent = 0.

    The equality filters reach the parquet scan when the matrix is read from
    files (row-group pruning on ``i``/``j`` statistics).
    """
    hit = m.df.filter((F.col("i") == F.lit(i)) & (F.col("j") == F.lit(j)))
    return hit.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")).select(
        F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), "v"
    )


def lookup_many(m: Mat, cells: list[tuple[int, int]]) -> DataFrame:
    """E9 for several cells in one scan: a filter on the key set, absent = 0.

    Every cell adds one zero row, so the driver-side list is the only thing
    that has to be small."""
    key = F.struct("i", "j")
    wanted = [F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in cells]
    asked = m.spark.createDataFrame([(i, j, 0.0) for i, j in cells], "i LONG, j LONG, v DOUBLE")
    near = F.col("i").isin([i for i, _ in cells]) & F.col("j").isin([j for _, j in cells])  # reaches the scan
    hits = m.df.filter(near & key.isin(wanted)).select("i", "j", "v")
    return hits.unionByName(asked).groupBy("i", "j").agg(F.sum("v").alias("v"))


def lookup_vec_many(x: Vec, indices: list[int]) -> DataFrame:
    """E9 on a vector for several indices in one scan, absent = 0."""
    asked = x.spark.createDataFrame([(i, 0.0) for i in indices], "i LONG, v DOUBLE")
    hits = x.df.filter(F.col("i").isin(indices)).select("i", "v")
    return hits.unionByName(asked).groupBy("i").agg(F.sum("v").alias("v"))


def lookup_vec(x: Vec, i: int) -> DataFrame:
    hit = x.df.filter(F.col("i") == F.lit(i))
    return hit.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")).select(
        F.lit(i).cast("long").alias("i"), "v"
    )


def row_normalize(m: Mat) -> Mat:
    """Divide each entry by its row's L1 norm.

    Row norms come from a map-side-combined aggregate (at most ``nrows``
    rows), then are joined back: broadcast when ``nrows`` fits, otherwise a
    shuffle join with hot rows split, so a row holding a third of all entries
    is never sent to one task (a window over ``i`` would do exactly that).
    """
    norms = m.df.groupBy("i").agg(F.sum(F.abs("v")).alias("_l1"))
    joined = join_by_bound(m.df, norms, ["i"], m.nrows)
    return _mat(Mat(joined, m.nrows, m.ncols), F.col("v") / F.col("_l1"))
