"""Matrix and vector builders.

Generators are written over ``spark.range`` so the work is split across tasks
by Spark and every random draw is a seeded column expression (``rand(seed)``
is deterministic per partition, so a recomputed task draws the same values).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import CONF_SEGMENT_COLS, ENTRY_SCHEMA, VECTOR_SCHEMA, Mat, Vec, canon, conf_int, idiv, range_checked, require, spread
from tessera.plans.generated import DenseCells, LineCells, MaskCells


def infer_shape(df: DataFrame) -> tuple[int, int]:
    """shape = max index + 1 (one aggregate job)."""
    r = df.agg(F.max("i").alias("mi"), F.max("j").alias("mj")).first()
    return (0 if r["mi"] is None else int(r["mi"]) + 1, 0 if r["mj"] is None else int(r["mj"]) + 1)


def from_entries(
    df: DataFrame,
    nrows: int | None = None,
    ncols: int | None = None,
    unique: bool = False,
    rows: int | None = None,
) -> Mat:
    """Build a canonical matrix from coordinate entries ``(i, j, v)``.

    Duplicates are summed (map-side combined aggregate), zeros and NaN dropped,
    and indices that are negative or outside a declared side raise at execution.  A shape ``<= 0`` or
    ``None`` is inferred (one job).  ``unique=True`` skips the aggregate when
    the caller guarantees unique keys (e.g. the output of a group-by).  ``rows`` is the
    number of rows where it is known and few of them share a key: many are dealt to
    partitions of a bounded number of rows and summed there (:func:`tessera.core.spread`).
    """
    e = df.select(
        F.col("i").cast("long").alias("i"),
        F.col("j").cast("long").alias("j"),
        F.col("v").cast("double").alias("v"),
    )
    if not unique:
        e = e if rows is None else spread(e, rows, "i", "j")
        e = e.groupBy("i", "j").agg(F.sum("v").alias("v"))
    e = range_checked(canon(e), nrows, ncols)
    if nrows is None or nrows <= 0 or ncols is None or ncols <= 0:
        r, c = infer_shape(e)
        nrows = r if nrows is None or nrows <= 0 else nrows
        ncols = c if ncols is None or ncols <= 0 else ncols
    return Mat(e, int(nrows), int(ncols))


def vector_from_entries(df: DataFrame, size: int | None = None, unique: bool = False) -> Vec:
    """Canonical vector from ``(i, v)`` entries; duplicates summed."""
    e = df.select(F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    if not unique:
        e = e.groupBy("i").agg(F.sum("v").alias("v"))
    e = range_checked(canon(e), size)
    if size is None or size <= 0:
        m = e.agg(F.max("i")).first()[0]
        size = 0 if m is None else int(m) + 1
    return Vec(e, int(size))


def to_rows(m: Mat, segment: int | None = None) -> DataFrame:
    """Row layout ``(i, seg, vec ARRAY<STRUCT<j, v>>)``, ``vec`` sorted by j.

    A record holds the entries of row ``i`` with ``j div segment == seg``, so
    it has at most ``segment`` entries (``tessera.layout.segmentCols``) even
    when one row holds a large share of the matrix; a row narrower than the
    segment width is one record with ``seg = 0``.  Records of a row cover
    disjoint, ordered column ranges.  The entry table stays canonical.
    """
    w = segment or conf_int(m.spark, CONF_SEGMENT_COLS)
    seg = idiv(F.col("j"), F.lit(w))
    return m.df.groupBy("i", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("vec"))


def to_columns(m: Mat, segment: int | None = None) -> DataFrame:
    """Column layout ``(j, seg, vec ARRAY<STRUCT<i, v>>)`` sorted by i, with
    the same per-record bound as :func:`to_rows`."""
    w = segment or conf_int(m.spark, CONF_SEGMENT_COLS)
    seg = idiv(F.col("i"), F.lit(w))
    return m.df.groupBy("j", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("vec"))


def from_rows(rows: DataFrame, nrows: int, ncols: int) -> Mat:
    """Inverse of :func:`to_rows`."""
    e = rows.select("i", F.explode("vec").alias("e")).select("i", "e.j", "e.v")
    return Mat(e, nrows, ncols)


def zeros(spark: SparkSession, nrows: int, ncols: int) -> Mat:
    """The additive identity (no stored entries)."""
    return Mat(spark.createDataFrame([], ENTRY_SCHEMA), nrows, ncols)


def zero_vector(spark: SparkSession, size: int) -> Vec:
    return Vec(spark.createDataFrame([], VECTOR_SCHEMA), size)


def _grid(spark: SparkSession, nrows: int, ncols: int) -> DataFrame:
    """All cells of an ``nrows x ncols`` grid, generated in parallel."""
    return spark.range(nrows * ncols).select(
        (F.col("id") % F.lit(nrows)).alias("i"), idiv(F.col("id"), F.lit(nrows)).alias("j")
    )


def _dealt_grid(spark: SparkSession, nrows: int, ncols: int, parts: int, chunk: int = 1_000_000) -> DataFrame:
    """:func:`_grid` with the columns dealt by hash to ``parts`` partitions before they are expanded, so that what is dealt by
    column alike meets the cells without moving them."""
    columns = spark.range(ncols if nrows > 0 else 0).select(F.col("id").alias("j")).repartition(parts, "j")
    tops = F.sequence(F.lit(0).cast("long"), F.lit(max(0, nrows - 1)).cast("long"), F.lit(chunk).cast("long"))
    cells = F.sequence(F.col("top"), F.least(F.col("top") + F.lit(chunk), F.lit(nrows).cast("long")) - F.lit(1))
    return columns.select("j", F.explode(tops).alias("top")).select(F.explode(cells).alias("i"), "j")


def ones(spark: SparkSession, nrows: int, ncols: int) -> Mat:
    """All-ones matrix (a dense result by definition)."""
    return Mat(_grid(spark, nrows, ncols).withColumn("v", F.lit(1.0)), nrows, ncols, dense=True)


def ones_vector(spark: SparkSession, size: int) -> Vec:
    """Ones vector of a given size."""
    return Vec(spark.range(size).select(F.col("id").alias("i"), F.lit(1.0).alias("v")), size)


def ones_like_index(idx: DataFrame, size: int) -> Vec:
    """Ones over an index set (column ``i``)."""
    return Vec(idx.select(F.col("i").cast("long").alias("i"), F.lit(1.0).alias("v")).distinct(), size)


def ones_for_columns(m: Mat) -> Vec:
    """S10 for a matrix: ones vector sized to its columns."""
    return ones_vector(m.spark, m.ncols)


_TWO53 = float(1 << 53)


def uniform_hash(seed: int, *cols: str | Column) -> Column:
    """Uniform [0, 1) value determined by ``(seed, cols)`` alone.

    A hash of the cell, not ``rand()``: ``rand`` depends on the partition
    index and row order, so the same generator would give other values on a
    cluster with another partition count.  Hash values are reproducible on
    any layout and under task retries.
    """
    h = F.xxhash64(F.lit(int(seed)), *cols)
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(_TWO53)


def normal_hash(seed: int, *cols: str | Column) -> Column:
    """Standard normal value from two cell hashes (Box-Muller)."""
    u1 = F.lit(1.0) - uniform_hash(seed, *cols)  # (0, 1]
    u2 = uniform_hash(seed + 0x9E3779B9, *cols)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def rand_matrix(
    spark: SparkSession, nrows: int, ncols: int, lo: float = 0.0, hi: float = 1.0, seed: int = 7, parts: int | None = None
) -> Mat:
    """Uniform dense random matrix on [lo, hi); ``parts`` deals its columns by hash to that many partitions."""
    g = _dealt_grid(spark, nrows, ncols, parts) if parts else _grid(spark, nrows, ncols)
    g = g.withColumn("v", uniform_hash(seed, "i", "j") * (hi - lo) + lo)
    return Mat(canon(g), nrows, ncols, dense=True, cells=DenseCells(nrows, ncols, seed, False, lo, hi))


def randn_matrix(spark: SparkSession, nrows: int, ncols: int, seed: int = 7, parts: int | None = None) -> Mat:
    """Standard normal dense random matrix; ``parts`` deals its columns by hash to that many partitions and leaves draws of
    zero in, so that every cell is stored."""
    g = _dealt_grid(spark, nrows, ncols, parts) if parts else _grid(spark, nrows, ncols)
    g = g.withColumn("v", normal_hash(seed, "i", "j"))
    return Mat(g if parts else canon(g), nrows, ncols, dense=True, cells=DenseCells(nrows, ncols, seed, True))


def _coprime_multiplier(n: int, seed: int) -> int:
    a = 2 * (seed % 9973) + 7919
    while math.gcd(a, n) != 1:
        a += 2
    return a


def sprand(
    spark: SparkSession, nrows: int, ncols: int, density: float, seed: int = 7, normal: bool = False, parts: int | None = None
) -> Mat:
    """Exactly ``ceil(m*n*density)`` distinct positions, uniform or normal values.

    Draw ``t`` in ``range(k)`` maps to cell ``(a*t + off) mod (m*n)`` with ``a``
    coprime to ``m*n``: a permutation of the cells, so the ``k`` positions are
    distinct with no sort, shuffle or de-duplication.  ``parts`` deals the columns by hash to that many partitions and
    draws the same positions a column at a time: those of one pass over all cells lie ``a`` apart.
    """
    n = nrows * ncols
    k = int(math.ceil(n * density))
    a = _coprime_multiplier(n, seed)
    off = (seed * 2654435761) % n if n else 0
    vals = normal_hash(seed, "i", "j") if normal else uniform_hash(seed, "i", "j")
    if parts and 0 < k and a * k + 2 * n < 1 << 62:
        num = lambda x: F.lit(x).cast("long")
        columns = spark.range(ncols).select(F.col("id").alias("j")).repartition(parts, "j")
        passes = columns.select("j", F.explode(F.sequence(num(0), num((a * (k - 1) + off) // n))).alias("p"))
        # Draw t of pass p is cell a*t + off - p*n; the first draws at or after a column's first cell and the next column's.
        shift = F.col("p") * num(n) - num(off)
        first = lambda c: F.greatest(idiv(c + shift + num(a - 1), num(a)), num(0))
        ends = passes.select("j", shift.alias("shift"), first(F.col("j") * num(nrows)).alias("t"), F.least(first((F.col("j") + 1) * num(nrows)), num(k)).alias("end"))
        drawn = ends.filter(F.col("t") < F.col("end")).select("j", "shift", F.explode(F.sequence(F.col("t"), F.col("end") - 1)).alias("t"))
        e = drawn.select((F.col("t") * num(a) - F.col("shift") - F.col("j") * num(nrows)).alias("i"), "j")
        return Mat(canon(e.withColumn("v", vals)), nrows, ncols, cells=MaskCells(nrows, ncols, seed, normal, a, off, k))
    # The product may pass 2**63, so it is taken in decimal(38, 0).
    product = F.col("id").cast("decimal(19,0)") * F.lit(a).cast("decimal(19,0)") + F.lit(off).cast("decimal(19,0)")
    cell = (product % F.lit(n).cast("decimal(19,0)")).cast("long")
    e = spark.range(k).select(
        (cell % F.lit(nrows)).alias("i"), idiv(cell, F.lit(nrows)).alias("j")
    )
    return Mat(canon(e.withColumn("v", vals)), nrows, ncols, cells=MaskCells(nrows, ncols, seed, normal, a, off, k))


def formula_matrix(
    spark: SparkSession, nrows: int, ncols: int, a: int, b: int, mod: int, offset: float = 0.0
) -> Mat:
    """Deterministic dense initialiser ``offset + pmod(a*i + b*j, mod)``
    (reproducible factor starts for the iterative plans); zeros dropped."""
    g = _grid(spark, nrows, ncols)
    v = (F.lit(float(offset)) + F.pmod(F.col("i") * F.lit(a) + F.col("j") * F.lit(b), F.lit(mod))).cast("double")
    return Mat(canon(g.withColumn("v", v)), nrows, ncols)


def eye(spark: SparkSession, n: int) -> Mat:
    """Identity (dense and sparse forms are the same table)."""
    return Mat(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, n)


def diag(v: Vec) -> Mat:
    """Diagonal matrix from a vector."""
    return Mat(canon(v.df.select("i", F.col("i").alias("j"), "v")), v.size, v.size)


def from_column_major(spark: SparkSession, nrows: int, ncols: int, values: list[float]) -> Mat:
    """Matrix from a column-major value array (driver-side literal input)."""
    require(len(values) == nrows * ncols, "values length must be nrows*ncols")
    arr = spark.createDataFrame([(list(map(float, values)),)], "vals ARRAY<DOUBLE>")
    e = arr.select(F.posexplode("vals").alias("pos", "v")).select(
        (F.col("pos") % F.lit(nrows)).cast("long").alias("i"),
        idiv(F.col("pos"), F.lit(nrows)).alias("j"),
        "v",
    )
    return Mat(canon(e), nrows, ncols)


def from_column_major_table(
    df: DataFrame, nrows: int, ncols: int, col: str = "vals", col_id: str | None = None
) -> Mat:
    """S17 over a table of arrays.

    With ``col_id`` each row holds one column (``nrows`` values) of the
    column-major array, so the whole array is spread over rows and nothing is
    held in one place.  Without it each row's array is a complete
    column-major ``nrows x ncols`` matrix and the rows are summed.
    """
    j = F.col(col_id).cast("long") if col_id else idiv(F.col("pos"), F.lit(nrows))
    keep = [col_id] if col_id else []
    e = df.select(*keep, F.posexplode(col).alias("pos", "v")).select(
        (F.col("pos") % F.lit(nrows)).cast("long").alias("i"),
        j.alias("j"),
        F.col("v").cast("double").alias("v"),
    )
    return from_entries(e, nrows, ncols, unique=col_id is not None)


def skew_schedule(lines: int, width: int, total: int, skew: float) -> list[tuple[int, int, int]]:
    """Per-line entry counts of the skewed generator as segments
    ``(first_line, end_line, count_per_line)``.

    Line ``k`` takes ``c_k = min(max(min(floor(r_k * skew), width), 1), r_k)``
    with ``r_0 = total`` and ``r_{k+1} = r_k - c_k``.  Runs of capped lines
    (``c = width``) and the tail of single-entry lines are closed-form
    segments, so the driver does O(log(total) / skew) steps, never one per line.
    """
    segs: list[tuple[int, int, int]] = []
    r, k = total, 0
    while r > 0 and k < lines:
        c = int(r * skew)
        if c >= width:
            # floor((r - t*width) * skew) >= width holds for t = 0..run-1.
            run = max(int((r - width / skew) // width) + 1, 1) if skew > 0 else 1
            run = min(run, lines - k, r // width)
            if run >= 1:
                while run > 1 and int((r - (run - 1) * width) * skew) < width:
                    run -= 1
                segs.append((k, k + run, width))
                r -= run * width
                k += run
                continue
        if c < 1:
            run = min(r, lines - k)
            segs.append((k, k + run, 1))
            r -= run
            k += run
            continue
        c = min(c, r)
        segs.append((k, k + 1, c))
        r -= c
        k += 1
    require(r == 0, f"{lines} lines cannot hold the total: {r} entries are left over")
    return segs


def skewed_sparse(
    spark: SparkSession,
    nrows: int,
    ncols: int,
    sparsity: float,
    skew: float,
    by: str = "row",
    seed: int = 11,
    chunk: int = 1_000_000,
    parts: int | None = None,
) -> Mat:
    """Skewed sparse generator.

    Per-line counts come from :func:`skew_schedule` (a handful of segments).
    Entries are generated on executors: each segment's lines are a
    ``spark.range``, each line is cut into chunks of at most ``chunk``
    positions, and ``explode(sequence)`` expands a chunk.  Position ``t`` of
    line ``k`` maps to ``(a*t + off_k) mod width`` with ``a`` coprime to
    ``width`` -- a permutation, so positions are distinct without any sort or
    window.  The drawn index is modulo its own axis (R29).  Values are cell
    hashes in (0, 1].  ``parts`` deals the lines by hash to that many partitions before they are expanded.
    """
    lines, width = (nrows, ncols) if by == "row" else (ncols, nrows)
    total = int(nrows * ncols * sparsity)
    segs = skew_schedule(lines, width, total, skew)
    a = _coprime_multiplier(width, seed)
    # Single-line segments form one small table (one row per line); the at
    # most two multi-line runs (capped lines, single-entry tail) are ranges.
    singles = [(lo, c) for lo, hi, c in segs if hi - lo == 1]
    runs = [(lo, hi, c) for lo, hi, c in segs if hi - lo > 1]
    lines_df = spark.createDataFrame(singles, "line LONG, c LONG")
    for lo, hi, c in runs:
        lines_df = lines_df.unionByName(
            spark.range(lo, hi).select(F.col("id").alias("line"), F.lit(c).cast("long").alias("c"))
        )
    if parts:
        lines_df = lines_df.repartition(parts, "line")
    nchunks = idiv(F.col("c") + F.lit(chunk - 1), F.lit(chunk))
    cells = lines_df.select(
        "line", "c", F.explode(F.sequence(F.lit(0).cast("long"), nchunks - 1)).alias("chunk")
    ).select(
        "line",
        F.explode(
            F.sequence(
                F.col("chunk") * F.lit(chunk),
                F.least(F.col("chunk") * F.lit(chunk) + F.lit(chunk), F.col("c")) - F.lit(1),
            )
        ).alias("t"),
    )
    off = F.pmod(F.xxhash64("line", F.lit(seed)), F.lit(width))
    pos = F.pmod(F.col("t") * F.lit(a) + off, F.lit(width))
    if by == "row":
        e = cells.select(F.col("line").alias("i"), pos.alias("j"))
    else:
        e = cells.select(pos.alias("i"), F.col("line").alias("j"))
    v = F.lit(1.0) - uniform_hash(seed, "i", "j")
    drawn = LineCells(ncols, seed, a, tuple(segs)) if by == "row" else None
    return Mat(e.withColumn("v", v), nrows, ncols, cells=drawn)
