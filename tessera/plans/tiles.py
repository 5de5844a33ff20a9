"""Dense tiles of entry tables, for products whose result is dense.

A tile holds ``rows x chunk`` cells of a table as one binary value, filled in numpy inside the task that gathered them.
Blocks of two tables meet by an equi-join on (block, chunk), one table's tiles being repeated for every block of the
other, and a pair of tiles is multiplied in numpy.  So what is shuffled or joined are tiles and never a row per
(left, right, inner) triple.  Every tile has the same bound, whatever the tables' sizes, and no key is hot: a
table has one tile for each block and chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import fits_broadcast, idiv, ship_package

TILE_CELLS = 1 << 18
CHUNK = 512
SENT_ROWS = 1 << 15  # rows of a result batch


@dataclass(frozen=True)
class Tiling:
    """Blocks of ``rows`` of ``n_rows`` indices by chunks of ``chunk`` of ``n_inner``."""

    n_rows: int
    n_inner: int
    rows: int
    chunk: int

    @classmethod
    def of(cls, n_rows: int, n_inner: int, cells: int = TILE_CELLS, chunk: int = CHUNK) -> "Tiling":
        chunk = max(1, min(n_inner, chunk, cells))
        return cls(n_rows, n_inner, max(1, min(n_rows, cells // chunk)), chunk)

    @property
    def blocks(self) -> int:
        return math.ceil(self.n_rows / self.rows) if self.n_rows else 0

    @property
    def chunks(self) -> int:
        return math.ceil(self.n_inner / self.chunk) if self.n_inner else 0

    def height(self, block: int) -> int:
        return min(self.rows, self.n_rows - block * self.rows)

    def width(self, chunk: int) -> int:
        return min(self.chunk, self.n_inner - chunk * self.chunk)

    def cells(self, block: int, chunk: int, data: bytes, dtype) -> np.ndarray:
        return np.frombuffer(data, dtype).reshape(self.height(block), self.width(chunk))


def few_rows_a_batch(df: DataFrame, cells: int) -> None:
    """Rows that hold a tile each go to Python a few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = max(1, (16 << 20) // max(1, 8 * cells))
    if not 0 < int(df.sparkSession.conf.get(key)) <= most:
        df.sparkSession.conf.set(key, most)


def dense_tiles(table: DataFrame, tiling: Tiling, dtype, fill=0) -> DataFrame:
    """``(block, chunk, cells)`` of ``table``: r, k, v.  Cells without an entry hold ``fill``; a tile without one does not exist."""
    ship_package(table.sparkSession)
    rows, chunk = F.lit(tiling.rows), F.lit(tiling.chunk)
    at = (F.col("r") % rows * chunk + F.col("k") % chunk).cast("int")
    kind = "double" if np.dtype(dtype).kind == "f" else "tinyint"
    gathered = (
        table.groupBy(idiv(F.col("r"), rows).alias("block"), idiv(F.col("k"), chunk).alias("chunk"))
        .agg(F.collect_list(F.struct(at.alias("at"), F.col("v").cast(kind).alias("v"))).alias("e"))
        .select("block", "chunk", F.col("e.at").alias("at"), F.col("e.v").alias("v"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, piece = (batch.column(c).to_pylist() for c in (0, 1))
            for n, (b, t) in enumerate(zip(block, piece)):
                cells = np.full((tiling.height(b), tiling.width(t)), fill, dtype)
                where = batch.column(2)[n].values.to_numpy()
                cells[where // tiling.chunk, where % tiling.chunk] = batch.column(3)[n].values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([t], pa.int64()), pa.array([cells.tobytes()], pa.binary())], names=["block", "chunk", "cells"])

    return gathered.mapInArrow(run, "block long, chunk long, cells binary")


def tile_pairs(left: DataFrame, right: DataFrame, tl: Tiling, tr: Tiling) -> DataFrame:
    """``(a, b, chunk, x, y)``: every left tile with every right tile of its chunk.  The side whose shape proves it small is
    broadcast and the other stays in place; else the left tiles are sent once for every block of the right."""
    spark = left.sparkSession
    x = left.select(F.col("block").alias("a"), "chunk", F.col("cells").alias("x"))
    y = right.select(F.col("block").alias("b"), "chunk", F.col("cells").alias("y"))
    ids = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    if fits_broadcast(spark, tl.n_rows * tl.n_inner) and tl.n_rows <= tr.n_rows:
        return y.withColumn("a", ids(max(1, tl.blocks))).join(F.broadcast(x), ["a", "chunk"])
    pairs = x.withColumn("b", ids(max(1, tr.blocks)))
    return pairs.join(F.broadcast(y) if fits_broadcast(spark, tr.n_rows * tr.n_inner) else y, ["b", "chunk"])


def per_pair(pairs: DataFrame, schema: str, fn: Callable[..., Iterator[dict]], cells: int) -> DataFrame:
    """Rows of ``schema`` from ``fn(a, b, chunk, x, y)``, which yields columns a few thousand rows at a time."""
    few_rows_a_batch(pairs, 2 * cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, chunk = (batch.column(c).to_pylist() for c in (0, 1, 2))
            for n in range(batch.num_rows):
                for columns in fn(a[n], b[n], chunk[n], batch.column(3)[n].as_buffer(), batch.column(4)[n].as_buffer()):
                    yield pa.RecordBatch.from_pydict(columns)

    return pairs.select("a", "b", "chunk", "x", "y").mapInArrow(run, schema)


def slabs(rows: int, columns: int) -> Iterator[slice]:
    """Runs of rows with about ``SENT_ROWS`` cells."""
    step = max(1, SENT_ROWS // max(1, columns))
    for lo in range(0, rows, step):
        yield slice(lo, min(rows, lo + step))


def product(left: DataFrame, right: DataFrame, n_left: int, n_right: int, n_inner: int, cells: int = TILE_CELLS) -> DataFrame:
    """``(i, j, v)`` of ``L Rᵀ``, zeros left out; ``left`` and ``right``: r, k, v with unique (r, k)."""
    tl, tr = Tiling.of(n_left, n_inner, cells), Tiling.of(n_right, n_inner, cells)
    pairs = tile_pairs(dense_tiles(left, tl, np.float64), dense_tiles(right, tr, np.float64), tl, tr)

    def multiply(a, b, chunk, x, y):
        x, y = tl.cells(a, chunk, x, np.float64), tr.cells(b, chunk, y, np.float64)
        for s in slabs(*(x.shape[0], y.shape[0])):
            z = x[s] @ y.T
            i, j = np.nonzero(z)
            yield {"i": i + (a * tl.rows + s.start), "j": j + b * tr.rows, "v": z[i, j]}

    parts = per_pair(pairs, "i long, j long, v double", multiply, cells)
    return parts if tl.chunks <= 1 else parts.groupBy("i", "j").agg(F.sum("v").alias("v"))
