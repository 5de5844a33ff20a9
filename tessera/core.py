"""Data model: a matrix is a DataFrame of non-zero entries ``(i, j, v)`` plus a
declared shape; a vector is ``(i, v)`` plus a declared size.

Canonical form (every operator output unless documented as a dense result):
unique keys, indices inside the shape, no ``v = 0`` and no NULL.  Because a
canonical matrix has at most ``nrows * ncols`` rows and a canonical vector at
most ``size`` rows, the declared shape is a *proven* upper bound on the row
count.  The broadcast decisions in this package rely only on that bound.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("i", T.LongType(), False),
        T.StructField("j", T.LongType(), False),
        T.StructField("v", T.DoubleType(), True),
    ]
)
VECTOR_SCHEMA = T.StructType(
    [T.StructField("i", T.LongType(), False), T.StructField("v", T.DoubleType(), True)]
)

# Session settings read by the library.  Defaults are sized for a cluster
# executor; tests lower them to exercise the skew paths on small data.
CONF_BROADCAST_ROWS = "tessera.broadcast.maxRows"
CONF_HOT_KEY_ROWS = "tessera.skew.hotKeyRows"
CONF_MAX_HOT_KEYS = "tessera.skew.maxHotKeys"
CONF_DENSE_CELLS = "tessera.dense.maxCells"
CONF_SEGMENT_COLS = "tessera.layout.segmentCols"

_DEFAULTS = {
    # 4M entries of (long, long, double) ~ 100 MB as a hashed relation.
    CONF_BROADCAST_ROWS: 4_000_000,
    # A join key or rank group with more rows than this is split across tasks.
    CONF_HOT_KEY_ROWS: 1_000_000,
    # Only this many of the hottest keys are split; their table is always broadcast.
    CONF_MAX_HOT_KEYS: 100_000,
    # Collect-to-local (K2) refuses larger shapes.
    CONF_DENSE_CELLS: 10_000_000,
    # Row/column layouts hold at most this many index values per record.
    CONF_SEGMENT_COLS: 1_000_000,
}


def conf_int(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(_DEFAULTS[key])))


def canon(df: DataFrame) -> DataFrame:
    """Drop stored zeros and NaN (NULL also fails the predicate)."""
    return df.filter((F.col("v") != F.lit(0.0)) & ~F.isnan("v"))


def idiv(a: Column, b: Column) -> Column:
    """Integer division of index columns (``/`` is floating point and rounds above 2**53)."""
    return F.call_function("div", a, b)


@dataclass(frozen=True)
class Mat:
    """A sparse matrix: canonical entry table plus declared shape."""

    df: DataFrame
    nrows: int
    ncols: int
    dense: bool = field(default=False, compare=False)
    formed: bool = field(default=False, compare=False)  # a product that is formed anew whenever it is read
    factors: object = field(default=None, compare=False)  # what a dealt product is made of
    cells: object = field(default=None, compare=False)  # what draws a generated matrix's cells (tessera.plans.generated)
    met: object = field(default=None, compare=False)  # what such a matrix was added to or multiplied with

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def cell_bound(self) -> int:
        """Proven upper bound on the number of stored entries."""
        return self.nrows * self.ncols

    @property
    def shape(self) -> tuple[int, int]:
        return (self.nrows, self.ncols)

    def entries(self) -> DataFrame:
        return self.df.select("i", "j", "v")

    # Algebra is implemented in ``tessera.operators``; these are conveniences.
    def __add__(self, other):
        from tessera.operators import algebra, elementwise

        if isinstance(other, Mat):
            return algebra.add(self, other)
        return elementwise.add_scalar(self, float(other))

    def __sub__(self, other):
        from tessera.operators import algebra, elementwise

        if isinstance(other, Mat):
            return algebra.subtract(self, other)
        return elementwise.add_scalar(self, -float(other))

    def __mul__(self, other):
        from tessera.operators import algebra, elementwise

        if isinstance(other, Mat):
            return algebra.elementwise_multiply(self, other)
        return elementwise.scale(self, float(other))

    __rmul__ = __mul__

    def __truediv__(self, other):
        from tessera.operators import algebra, elementwise

        if isinstance(other, Mat):
            return algebra.elementwise_divide(self, other)
        return elementwise.divide_scalar(self, float(other))

    def __matmul__(self, other):
        from tessera.operators import algebra

        if isinstance(other, Vec):
            return algebra.matvec(self, other)
        return algebra.matmul(self, other)

    def __pow__(self, p):
        from tessera.operators import elementwise

        return elementwise.power(self, float(p))

    @property
    def T(self) -> "Mat":
        from tessera.operators import elementwise

        return elementwise.transpose(self)


@dataclass(frozen=True)
class Vec:
    """A sparse vector: canonical ``(i, v)`` table plus declared size."""

    df: DataFrame
    size: int

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def cell_bound(self) -> int:
        return self.size

    def entries(self) -> DataFrame:
        return self.df.select("i", "v")

    def __add__(self, other: "Vec") -> "Vec":
        from tessera.operators import algebra

        return algebra.vec_add(self, other)

    def __mul__(self, alpha: float) -> "Vec":
        from tessera.operators import elementwise

        return elementwise.scale_vec(self, float(alpha))

    __rmul__ = __mul__


def fits_broadcast(spark: SparkSession, bound: int) -> bool:
    """True when a side with at most ``bound`` rows may be broadcast."""
    return 0 <= bound <= conf_int(spark, CONF_BROADCAST_ROWS)


ROWS_A_TASK = 1 << 20  # rows of an aggregate by unique keys that a task holds, about


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of ``rows`` rows, hash-partitioned by ``keys`` with about ``ROWS_A_TASK`` rows a partition, so that what an aggregate
    or a join on the keys holds in a task does not grow with the table; few rows stay where they are.  Partitions whose number is
    given are not joined by adaptive execution, whose target is in compressed bytes."""
    parts = math.ceil(rows / ROWS_A_TASK)
    if parts <= 1:
        return df
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)


def require(cond: bool, msg: str) -> None:
    if not cond:
        raise ValueError(msg)


def range_checked(df: DataFrame, nrows: int | None, ncols: int | None = None) -> DataFrame:
    """Raise at execution time if an index leaves the declared shape.

    The check is a filter on the keys that keeps every row or raises, so no
    projection can prune it, and key filters still reach the parquet scan.
    A side that is ``None`` or not positive is undeclared and only has to be
    non-negative.
    """
    bad = F.col("i") < 0
    if nrows is not None and nrows > 0:
        bad = bad | (F.col("i") >= F.lit(nrows))
    if "j" in df.columns:
        bad = bad | (F.col("j") < 0)
        if ncols is not None and ncols > 0:
            bad = bad | (F.col("j") >= F.lit(ncols))
    msg = f"index outside declared shape ({nrows}, {ncols})"
    return df.filter(F.when(bad, F.raise_error(F.lit(msg)).cast("boolean")).otherwise(F.lit(True)))


# ---------------------------------------------------------------------------
# Lineage cutting for iterative plans
# ---------------------------------------------------------------------------


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder (HDFS, S3,
    ...).  Only a local-mode session without that setting (tests, laptops) gets
    a private folder under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative plans need a shared folder"
        )
    path = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the checkpoint folder and read
    it back.

    This is a reliable cut: the data lives in the shared folder, so a lost
    executor does not force recomputation of the history (a local
    checkpoint would).  It also resets the optimizer's size estimate to the
    real file size -- an RDD checkpoint keeps the estimate of the plan it
    replaced, and in iterative algorithms whose iterates feed each other
    through joins that estimate compounds every step.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tessera-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.parquet(path)
    out._tessera_path = path
    return out


def drop_lineage(df: DataFrame) -> None:
    """Delete the table behind a superseded :func:`cut_lineage` result; any other
    DataFrame is left alone."""
    path = getattr(df, "_tessera_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_bucketed(df: DataFrame, buckets: int, column: str, in_place: bool = False) -> DataFrame:
    """:func:`cut_lineage` into a table bucketed and sorted by ``column``: read back, it has the partitioning that a
    shuffle on ``column`` to ``buckets`` partitions would give, so a join or an aggregate on it moves nothing.
    ``in_place`` states that ``df`` lies in such partitions already.  :func:`drop_lineage` deletes the files."""
    spark = df.sparkSession
    name = f"tessera_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    even = df if in_place else df.repartition(buckets, column)  # a task writes one bucket
    even.write.format("parquet").option("path", path).bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay
    out._tessera_path = path
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle before adaptive execution joins any."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    adaptive = all(spark.conf.get(k, "true") == "true" for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"))
    return int(first if first and adaptive else spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def joins_in_place(spark: SparkSession) -> Iterator[None]:
    """While it holds, a join or an aggregate may use a partitioning on part of its keys.  This is read when a plan is run, so
    what needs it has to be written before it ends."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as
    ``--py-files`` would: the driver's import path is not the executors'."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-py-")) / f"{package.name}.zip"  # Spark's file server hands it out
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._tessera_shipped = True


def as_long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def as_double(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")
