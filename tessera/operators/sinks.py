"""Sinks and inspection (K1-K5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import CONF_DENSE_CELLS, Mat, Vec, conf_int, idiv, require

_SHAPE = "nrows LONG, ncols LONG, size LONG, fmt STRING"
_TEXT = ("csv", "tsv", "text")  # tab-separated text under any of these names


def save(m: Mat | Vec, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K1: write the entry table (parquet by default, or tab-separated text).

    The declared shape and the format are written next to the data as a one-row JSON table
    in ``<path>/_shape`` (names starting with ``_`` are skipped by Spark's
    file readers), so :func:`load` restores the shape without scanning.
    """
    w = m.df.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt in _TEXT:
        w.option("sep", "\t").csv(path)
    else:
        w.format(fmt).save(path)
    shape = (m.nrows, m.ncols, None) if isinstance(m, Mat) else (None, None, m.size)
    m.spark.createDataFrame([(*shape, fmt)], _SHAPE).write.mode("overwrite").json(path + "/_shape")


def load(spark, path: str) -> Mat | Vec:
    """Read back a matrix or vector written by :func:`save`, in the format it was saved in."""
    shape = spark.read.schema(_SHAPE).json(path + "/_shape").first()
    fmt, entries = shape["fmt"] or "parquet", "i LONG, j LONG, v DOUBLE" if shape["size"] is None else "i LONG, v DOUBLE"
    if fmt in _TEXT:
        df = spark.read.schema(entries).option("sep", "\t").csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    if shape["size"] is not None:
        return Vec(df.select("i", "v"), int(shape["size"]))
    return Mat(df.select("i", "j", "v"), int(shape["nrows"]), int(shape["ncols"]))


_LAYOUT = "nrows LONG, ncols LONG, axis STRING, block LONG, group LONG"
MOST_FOLDERS = 1000


@dataclass(frozen=True)
class StoredBlocks:
    """A matrix written by :func:`save_blocks`: entries with the block of their row (or column) as the
    partition column ``blk``, so a filter on blocks reads only their files.  Of a matrix of many blocks the folder ``blk`` holds
    ``group`` blocks, in order."""

    table: DataFrame
    nrows: int
    ncols: int
    axis: str
    block: int
    group: int = 1

    def matrix(self) -> Mat:
        return Mat(self.table.select("i", "j", "v"), self.nrows, self.ncols)

    def _of(self, i: int, j: int) -> int:
        return (i if self.axis == "row" else j) // self.block

    def lookup(self, cells: list[tuple[int, int]]) -> DataFrame:
        """E9 for several cells, absent = 0: reads the files of the cells' blocks, and in them the row groups whose
        statistics admit the cells."""
        from tessera.operators.elementwise import lookup_many

        blocks = sorted({self._of(i, j) // self.group for i, j in cells})
        near = self.table.filter(F.col("blk").isin(blocks)).select("i", "j", "v")
        return lookup_many(Mat(near, self.nrows, self.ncols), cells)

    def block_nnz_sample(self, block: int, ratio: float) -> DataFrame:
        """A7 along the stored axis, from the sampled blocks' files alone.  ``block`` is a multiple of the stored one."""
        from tessera.operators.aggregates import _sampled_blocks

        require(block % self.block == 0, f"blocks of {block} are not made of stored blocks of {self.block}")
        dim = self.nrows if self.axis == "row" else self.ncols
        n_sampled, step = _sampled_blocks(-(-dim // block), ratio)
        if self.group == 1:
            b = idiv(F.col("blk"), F.lit(block // self.block))
        else:
            b = idiv(F.col("i" if self.axis == "row" else "j"), F.lit(block))
        keep = (F.pmod(b, F.lit(step)) == 0) & (idiv(b, F.lit(step)) < F.lit(n_sampled))
        counts = self.table.filter(keep).groupBy(b.alias("block")).agg(F.count(F.lit(1)).alias("nnz"))
        return counts.select(F.lit(self.axis).alias("axis"), "block", "nnz")


def save_blocks(m: Mat, path: str, block: int, axis: str = "row", mode: str = "overwrite") -> None:
    """K1 in a layout for lookups and block samples: entries are range-partitioned by (block, i, j), so a block with most
    of the entries is cut over many files, sorted, and written with the block as partition column.  Beyond ``MOST_FOLDERS``
    blocks several neighbours share a folder, so that folders and files do not grow with the matrix."""
    require(axis in ("row", "col") and block > 0, "a positive block of rows or columns")
    order = ["i", "j"] if axis == "row" else ["j", "i"]
    group = max(1, -(-(-(-(m.nrows if axis == "row" else m.ncols) // block)) // MOST_FOLDERS))
    blk: Column = idiv(F.col(order[0]), F.lit(block * group)).alias("blk")
    t = m.df.select("i", "j", "v", blk).repartitionByRange("blk", *order).sortWithinPartitions("blk", *order)
    t.write.mode(mode).partitionBy("blk").parquet(path)
    m.spark.createDataFrame([(m.nrows, m.ncols, axis, block, group)], _LAYOUT).write.mode("overwrite").json(path + "/_layout")


def load_blocks(spark, path: str) -> StoredBlocks:
    """A matrix written by :func:`save_blocks`."""
    shape = spark.read.schema(_LAYOUT).json(path + "/_layout").first()
    table = spark.read.schema("i LONG, j LONG, v DOUBLE, blk LONG").parquet(path)
    return StoredBlocks(table, shape["nrows"], shape["ncols"], shape["axis"], shape["block"], shape["group"] or 1)


def to_local(m: Mat):
    """K2: collect to a numpy array -- debug only, refused above a cell bound."""
    import numpy as np

    require(m.cell_bound <= conf_int(m.spark, CONF_DENSE_CELLS), "matrix too large to collect")
    out = np.zeros((m.nrows, m.ncols))
    for r in m.df.toLocalIterator():
        out[r["i"], r["j"]] += r["v"]
    return out


def to_local_vec(x: Vec):
    import numpy as np

    require(x.size <= conf_int(x.spark, CONF_DENSE_CELLS), "vector too large to collect")
    out = np.zeros(x.size)
    for r in x.df.toLocalIterator():
        out[r["i"]] += r["v"]
    return out


def display(m: Mat | Vec, n: int = 20) -> None:
    """K4: print entries."""
    m.df.orderBy(*([c for c in ("i", "j") if c in m.df.columns])).show(n, truncate=False)


def validate(m: Mat) -> DataFrame:
    """K5: one-row report: duplicate keys, out-of-shape indices, zeros, NULLs.

    One group-by on the key (partial aggregate) followed by a global sum.
    """
    oos = (F.col("i") < 0) | (F.col("i") >= m.nrows) | (F.col("j") < 0) | (F.col("j") >= m.ncols)
    per_key = m.df.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum(F.when(oos, 1).otherwise(0)).alias("oos"),
        F.sum(F.when(F.col("v") == 0, 1).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.col("v").isNull() | F.isnan("v"), 1).otherwise(0)).alias("nulls"),
    )
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("nnz"),
        F.coalesce(F.sum(F.when(F.col("c") > 1, 1).otherwise(0)), F.lit(0)).cast("long").alias("duplicate_keys"),
        F.coalesce(F.sum("oos"), F.lit(0)).cast("long").alias("out_of_shape"),
        F.coalesce(F.sum("zeros"), F.lit(0)).cast("long").alias("zeros"),
        F.coalesce(F.sum("nulls"), F.lit(0)).cast("long").alias("nulls"),
    )
