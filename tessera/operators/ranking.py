"""Ranking, running counts, top-k and union.

Ranks are computed from a pre-aggregated ``(row, value, count)`` table and a
distributed prefix sum (:mod:`tessera.plans.skew`): ties collapse before any
shuffle, and a row with a third of all entries is range-partitioned by value
instead of being sorted by one task.  Ranks are DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Mat, Vec
from tessera.plans.skew import prefix_sum, ranks


def rank_rows_average(table: DataFrame, row: str = "i", col: str = "j", value: str = "v") -> DataFrame:
    """Rank each row's values, ties averaged, missing (NULL) ranked last in
    column order.  ``table`` is a *complete* table: zeros are values here.
    Returns ``(row, col, value, rank)``."""
    r = ranks(table.select(row, col, value), [row], value, col)
    return r.select(row, col, value, F.col("rank_avg").alias("rank"))


def rank_rows_min(table: DataFrame, row: str = "i", col: str = "j", value: str = "v") -> DataFrame:
    """Rank each row's values, ties share the minimum rank, missing last."""
    r = ranks(table.select(row, col, value), [row], value, col)
    return r.select(row, col, value, F.col("rank_min").alias("rank"))


def running_count(
    table: DataFrame, group_cols: list[str], order_col: str, flag_col: str, out_col: str = "cum"
) -> DataFrame:
    """Running count of ``flag_col`` (0/1) in ascending ``order_col`` within
    groups, inclusive (distributed prefix sum)."""
    t = table.withColumn("_w", F.col(flag_col).cast("long"))
    return prefix_sum(t, group_cols, order_col, "_w", out_col).drop("_w")


def top_k(m: Mat, k: int) -> DataFrame:
    """The ``k`` largest stored entries, order ``v desc, i, j``.

    ``orderBy + limit`` plans TakeOrderedAndProject: every task keeps k rows,
    one task merges ``k * tasks`` rows.  The limit is the feature.
    """
    return m.df.orderBy(F.col("v").desc(), F.col("i"), F.col("j")).limit(k)


def top_k_vector(x: Vec, k: int) -> DataFrame:
    """The ``k`` largest entries of a vector, order ``v desc, i``."""
    return x.df.orderBy(F.col("v").desc(), F.col("i")).limit(k)


def union(a: Mat, b: Mat) -> DataFrame:
    """Bag union of entry tables, ``(i, j, v)``.

    A cell may occur twice, so the result is no matrix: its shape bounds nothing, and
    a product that trusted it could broadcast more than it proves.  ``from_entries``
    or :func:`tessera.operators.algebra.add` make a matrix of summed cells.
    """
    return a.entries().unionByName(b.entries())
