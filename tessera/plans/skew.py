"""Skew-safe building blocks.

Two primitives are used across the package wherever a key or a group can be
hot (assume one key may hold a third of all rows):

* :func:`salted_join` -- an inner equi-join that splits every hot key over
  several tasks.  Hot keys are found with a map-side-combined count; rows of a
  hot key are spread by a content hash (deterministic, so a lost task recomputes
  the same split) and the other side's rows of that key are replicated once per
  split.  Both sides may be split at once (2-D), so a key that is hot on both
  sides is cut into ``sl * sr`` tasks.
* :func:`prefix_sum` -- an inclusive running sum inside groups, ordered by one
  column.  With a group larger than the threshold the rows are range-partitioned
  by (group, order): partitions are even whatever the groups' sizes, each sums
  its rows in one pass, and only a partition's first group needs an offset, which
  follows from one row a partition.

What reaches the driver is bounded: only the ``maxHotKeys`` largest keys are split,
so a key that is left whole has at most ``max(hotKeyRows, N / maxHotKeys)`` of the
``N`` rows, and offsets are one row a partition.  The hot-key table is therefore
always broadcast, never joined by a shuffle on the bare key.

Groups are compared null-safely: NULL group values form a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.core import CONF_HOT_KEY_ROWS, CONF_MAX_HOT_KEYS, conf_int, cut_lineage, require, ship_package

_SALT_L = "_salt_l"
_SALT_R = "_salt_r"
_NL = "_nsplit_l"
_NR = "_nsplit_r"


def _hot_counts(df: DataFrame, keys: list[str], threshold: int, name: str) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > F.lit(threshold))
        .select(*keys, F.ceil(F.col("_n") / F.lit(threshold)).cast("int").alias(name))
    )


def _hottest(hot: DataFrame, sizes: list[str], max_rows: int) -> DataFrame | None:
    """The ``max_rows`` rows of greatest size as a table for broadcasting; ``None`` if there is none."""
    order = F.greatest(*sizes) if len(sizes) > 1 else F.col(sizes[0])
    rest = [F.col(c) for c in hot.columns if c not in sizes]
    rows = hot.orderBy(order.desc(), *rest).limit(max_rows).collect()
    return F.broadcast(hot.sparkSession.createDataFrame(rows, hot.schema)) if rows else None


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with more rows than the hot-key threshold, at most ``maxHotKeys`` of them, as a table for broadcasting; ``None`` if
    there is none."""
    spark = df.sparkSession
    counts = _hot_counts(df, keys, conf_int(spark, CONF_HOT_KEY_ROWS), "_n")
    hot = _hottest(counts, ["_n"], conf_int(spark, CONF_MAX_HOT_KEYS))
    return None if hot is None else F.broadcast(hot.select(*keys))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    split_left: bool = True,
    split_right: bool = True,
    same_key_counts: bool = False,
) -> DataFrame:
    """Inner equi-join on the shared columns ``keys`` with hot keys split.

    Pass ``split_left=False`` / ``split_right=False`` for a side whose keys are
    known to be unique (a vector, a per-group table): its hot-key count is then
    skipped.  ``same_key_counts=True`` states that both sides have the same
    number of rows per key (``A`` against ``Aᵀ`` on the inner index), so
    the keys are counted once.
    """
    spark = left.sparkSession
    threshold = conf_int(spark, CONF_HOT_KEY_ROWS)
    max_hot = conf_int(spark, CONF_MAX_HOT_KEYS)

    parts = []
    if same_key_counts and split_left and split_right:
        c = _hot_counts(left, keys, threshold, _NL)
        parts.append(c.withColumn(_NR, F.col(_NL)))
    else:
        if split_left:
            parts.append(_hot_counts(left, keys, threshold, _NL))
        if split_right:
            parts.append(_hot_counts(right, keys, threshold, _NR))
    if not parts:
        return left.join(right, keys, "inner")
    hot = parts[0]
    for p in parts[1:]:
        hot = hot.join(p, keys, "full")
    if _NL not in hot.columns:
        hot = hot.withColumn(_NL, F.lit(1))
    if _NR not in hot.columns:
        hot = hot.withColumn(_NR, F.lit(1))
    hot = hot.select(
        *keys,
        F.coalesce(F.col(_NL), F.lit(1)).alias(_NL),
        F.coalesce(F.col(_NR), F.lit(1)).alias(_NR),
    )

    table = _hottest(hot, [_NL, _NR], max_hot)
    if table is None:
        # No hot key: an ordinary shuffle join is balanced.
        return left.join(right, keys, "inner")

    nl = F.coalesce(F.col(_NL), F.lit(1))
    nr = F.coalesce(F.col(_NR), F.lit(1))
    lcols = [F.col(c) for c in left.columns]
    rcols = [F.col(c) for c in right.columns]
    lhs = (
        left.join(table, keys, "left")
        .withColumn(_SALT_L, F.pmod(F.xxhash64(*lcols), nl.cast("long")))
        .withColumn(_SALT_R, F.explode(F.sequence(F.lit(0).cast("long"), (nr - 1).cast("long"))))
        .drop(_NL, _NR)
    )
    rhs = (
        right.join(table, keys, "left")
        .withColumn(_SALT_R, F.pmod(F.xxhash64(*rcols), nr.cast("long")))
        .withColumn(_SALT_L, F.explode(F.sequence(F.lit(0).cast("long"), (nl - 1).cast("long"))))
        .drop(_NL, _NR)
    )
    return lhs.join(rhs, keys + [_SALT_L, _SALT_R], "inner").drop(_SALT_L, _SALT_R)


# Partitions of a ranged pass: as many as keep a partition near the hot-key threshold, within these multiples of the
# session's shuffle partitions.
_MOST_PARTS = 32

_PART, _FIRST, _ROW = "_part", "_first", "_row"


def _same_as_before(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """For every row after the first: whether all ``columns`` equal the row before's; NULLs and NaNs are equal."""
    same = np.ones(max(0, batch.num_rows - 1), bool)
    for name in columns:
        column = batch.column(name)
        if pa.types.is_nested(column.type):
            values = column.to_pylist()
            equal = np.fromiter((x == y for x, y in zip(values[1:], values)), bool, len(same))
        else:
            x, y = column.slice(1), column.slice(0, len(same))
            equal = pc.fill_null(pc.equal(x, y), False).to_numpy(zero_copy_only=False)
            equal |= (pc.is_null(x, nan_is_null=True).to_numpy(zero_copy_only=False)) & (pc.is_null(y, nan_is_null=True).to_numpy(zero_copy_only=False))
        same &= equal
    return same


def _running(weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Inclusive running sums that begin anew at every index of ``starts``."""
    if weights.dtype.kind == "f":  # differences of one long sum would lose digits
        return np.concatenate([np.cumsum(x) for x in np.split(weights, starts[starts > 0])]) if len(weights) else weights
    total = np.cumsum(weights)
    before = np.append(0, total)[starts]
    return total - np.repeat(before, np.diff(np.append(starts, len(weights))))


def _ranged_sums(df: DataFrame, group_cols: list[str], order_col: str, weight_col: str, out_col: str, rows: int) -> DataFrame:
    """:func:`prefix_sum` for groups of any size.

    Rows are range-partitioned by (group, order) and sorted, so partitions are even whatever the groups' sizes, a group
    lies in consecutive partitions, and at most the first group of a partition goes on from the one before.  One
    pass over a partition's sorted rows keeps the running sum of the current group only.  The result is written; what each
    partition's last group has summed up is one small row a partition, from which follows the offset of the next
    partition's first group.
    """
    spark = df.sparkSession
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(session, math.ceil(rows / conf_int(spark, CONF_HOT_KEY_ROWS))), _MOST_PARTS * session)
    kind = df.select(F.sum(weight_col).alias("s")).schema["s"].dataType
    require(isinstance(kind, (T.LongType, T.DoubleType)), f"{weight_col} has to be an integer or floating point column")
    ship_package(spark)
    ordered = df.withColumn("_w", F.coalesce(F.col(weight_col).cast(kind), F.lit(0).cast(kind)))
    groups, made = [], []
    for c in group_cols:  # the fields of a struct compare faster than the struct
        fields = df.schema[c].dataType.names if isinstance(df.schema[c].dataType, T.StructType) else []
        for f in fields:
            made.append(f"_k{len(made)}")
            ordered = ordered.withColumn(made[-1], F.col(c).getField(f))
        groups += made[len(made) - len(fields) :] if fields else [c]
    ordered = ordered.repartitionByRange(parts, *groups, order_col).sortWithinPartitions(*groups, order_col)
    ordered = ordered.withColumn(_PART, F.spark_partition_id())
    added = [T.StructField(out_col, kind), T.StructField(_FIRST, T.BooleanType()), T.StructField(_ROW, T.LongType())]
    schema = T.StructType([f for f in ordered.schema if f.name != "_w"] + added)
    names = [f.name for f in schema][: -len(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, first, row = None, 0, True, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.select(groups) if groups else None
            same = _same_as_before(batch, groups)
            starts = np.append(0, np.flatnonzero(~same) + 1)
            sums = _running(batch.column("_w").to_numpy(), starts)
            goes_on = last is not None
            if goes_on and groups:
                pair = pa.Table.from_batches([last, keys.slice(0, 1)]).combine_chunks().to_batches()[0]
                goes_on = bool(_same_as_before(pair, groups)[0])
            end = starts[1] if len(starts) > 1 else n
            if goes_on:
                sums[:end] += total
            if last is not None and not goes_on:
                first = False
            flags = np.zeros(n, bool)
            if first:
                flags[:end] = True
                first = len(starts) == 1
            total, last = sums[-1], (keys.slice(n - 1) if groups else batch.slice(n - 1))
            columns = [batch.column(c) for c in names] + [pa.array(sums), pa.array(flags), pa.array(np.arange(row, row + n))]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=[*names, out_col, _FIRST, _ROW])

    done = cut_lineage(ordered.mapInArrow(run, schema))
    at_end = F.struct(*[F.col(c).alias(f"g{k}") for k, c in enumerate(groups)], F.col(out_col).alias("s"), F.col(_FIRST).alias("f"))
    at_start = F.struct(F.lit(0).alias("z"), *[F.col(c).alias(f"g{k}") for k, c in enumerate(groups)])
    edges = done.groupBy(_PART).agg(F.min_by(at_start, _ROW).alias("a"), F.max_by(at_end, _ROW).alias("b")).orderBy(_PART).collect()
    zero = 0.0 if isinstance(kind, T.DoubleType) else 0
    offsets, carried, group = [], zero, None
    for e in edges:
        begins, ends = tuple(e.a)[1:], tuple(e.b)[: len(groups)]
        offset = carried if group is not None and _equal(group, begins) else zero
        offsets.append((e[_PART], offset))
        carried, group = e.b.s + (offset if e.b.f else zero), ends
    table = F.broadcast(spark.createDataFrame(offsets, T.StructType([T.StructField(_PART, T.IntegerType()), T.StructField("_off", kind)])))
    out = done.join(table, _PART).withColumn(out_col, F.col(out_col) + F.when(F.col(_FIRST), F.col("_off")).otherwise(F.lit(0).cast(kind)))
    return out.drop(_PART, _FIRST, _ROW, "_off", *made)


def _equal(x: tuple, y: tuple) -> bool:
    return all(a == b or (a != a and b != b) for a, b in zip(x, y))


def prefix_sum(
    df: DataFrame,
    group_cols: list[str],
    order_col: str,
    weight_col: str,
    out_col: str,
) -> DataFrame:
    """Add ``out_col`` = running sum of ``weight_col`` within ``group_cols`` in
    ascending ``order_col`` (inclusive; a NULL weight adds nothing).  ``order_col`` must be
    non-null and unique within a group.  Without group columns the rows are one
    group.  Groups up to the hot-key threshold are summed by a window, as long as
    there is no larger one; else all rows take the ranged pass (:func:`_ranged_sums`).
    """
    spark = df.sparkSession
    sizes = (df.groupBy(*group_cols) if group_cols else df.groupBy(F.lit(0).alias("_all"))).agg(F.count(F.lit(1)).alias("_gn"))
    largest, rows = sizes.agg(F.max("_gn"), F.sum("_gn")).first()
    if (largest or 0) > conf_int(spark, CONF_HOT_KEY_ROWS):
        return _ranged_sums(df, group_cols, order_col, weight_col, out_col, rows)
    by_group = Window.partitionBy(*(group_cols or [F.lit(0)])).orderBy(F.col(order_col))
    w = by_group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out_col, F.sum(F.coalesce(F.col(weight_col), F.lit(0))).over(w))


def ranks(
    df: DataFrame,
    group_cols: list[str],
    value_col: str,
    tiebreak_col: str,
) -> DataFrame:
    """Rank ``value_col`` inside each group, ascending, skew-safe.

    Adds ``rank_min`` (ties share the minimum) and ``rank_avg`` (ties get the
    average of the positions they span).  Missing values (NULL) rank last and
    get distinct ranks in ``tiebreak_col`` order, after all present values.
    Both ranks are DOUBLE.

    Groups up to the hot-key threshold are ranked with window functions
    (one shuffle on the group key; a group is bounded, so it fits a task).
    Hot groups -- and a single global group -- take the ranged pass
    (:func:`_ranks_split`), so no group larger than the threshold is ever
    sorted in one task.
    """
    G = list(group_cols)
    if not G:
        return _ranks_split(df, G, value_col, tiebreak_col)
    spark = df.sparkSession
    threshold = conf_int(spark, CONF_HOT_KEY_ROWS)
    max_hot = conf_int(spark, CONF_MAX_HOT_KEYS)
    df = df.withColumn("_group", F.struct(*G))  # never NULL, so NULL groups join
    sizes = df.groupBy("_group").agg(F.count(F.lit(1)).alias("_gn"))
    hot = _hottest(sizes.filter(F.col("_gn") > F.lit(threshold)), ["_gn"], max_hot)
    if hot is None:
        return _ranks_window(df, G, value_col, tiebreak_col).drop("_group")
    keyed = hot.select("_group")
    cold_rows = df.join(F.broadcast(keyed), "_group", "left_anti")
    hot_rows = df.join(F.broadcast(keyed), "_group", "left_semi")
    return (
        _ranks_window(cold_rows, G, value_col, tiebreak_col)
        .unionByName(_ranks_split(hot_rows, ["_group"], value_col, tiebreak_col))
        .drop("_group")
    )


def _ranks_window(df: DataFrame, G: list[str], value_col: str, tiebreak_col: str) -> DataFrame:
    """:func:`ranks` for groups known to be bounded: window functions over a
    hash partitioning on the group key (which also serves the tie count
    partitioned by ``group + value``)."""
    v = F.col(value_col)
    by_value = Window.partitionBy(*G).orderBy(v.asc_nulls_last())
    by_position = Window.partitionBy(*G).orderBy(v.asc_nulls_last(), F.col(tiebreak_col))
    ties = Window.partitionBy(*G, value_col)
    r = F.rank().over(by_value).cast("double")
    pos = F.row_number().over(by_position).cast("double")
    c = F.count(F.lit(1)).over(ties).cast("double")
    return df.withColumn("rank_min", F.when(v.isNull(), pos).otherwise(r)).withColumn(
        "rank_avg", F.when(v.isNull(), pos).otherwise(r + (c - 1) / 2.0)
    )


def _ranks_split(
    df: DataFrame,
    group_cols: list[str],
    value_col: str,
    tiebreak_col: str,
) -> DataFrame:
    """:func:`ranks` for hot (or global) groups: ties are pre-aggregated to
    one row per (group, value), running counts come from
    :func:`prefix_sum`, and ranks are joined back with hot keys split."""
    G = list(group_cols)
    present = df.filter(F.col(value_col).isNotNull())
    missing = df.filter(F.col(value_col).isNull())

    # Pre-aggregate ties: one row per distinct (group, value).
    vc = present.groupBy(*G, value_col).agg(F.count(F.lit(1)).alias("_c"))
    vc = prefix_sum(vc, G, value_col, "_c", "_cum")
    vc = vc.select(
        *G,
        value_col,
        (F.col("_cum") - F.col("_c") + 1).cast("double").alias("rank_min"),
        (F.col("_cum") - (F.col("_c") - 1) / 2.0).cast("double").alias("rank_avg"),
    )
    ranked_present = salted_join(present, vc, G + [value_col], split_right=False)

    # Missing values: position among the group's missing entries, shifted by
    # the group's count of present values.
    miss = missing.withColumn("_one", F.lit(1).cast("long"))
    miss = prefix_sum(miss, G, tiebreak_col, "_one", "_pos").drop("_one")
    n_present = (df.groupBy(*G) if G else df.groupBy()).agg(
        F.count(F.col(value_col)).alias("_np")
    )
    if G:
        miss = salted_join(miss, n_present, G, split_right=False)
    else:
        miss = miss.withColumn("_np", F.lit(n_present.first()[0]).cast("long"))
    r = (F.col("_np") + F.col("_pos")).cast("double")
    ranked_missing = miss.withColumn("rank_min", r).withColumn("rank_avg", r).drop("_np", "_pos")
    return ranked_present.unionByName(ranked_missing)


def join_by_bound(
    big: DataFrame, small: DataFrame, keys: list[str], small_bound: int
) -> DataFrame:
    """Inner join of ``big`` with a side whose keys are unique.

    ``small_bound`` is a proven upper bound on ``small``'s row count (a declared
    vector size or row count).  Within the broadcast limit the small side is
    broadcast -- ``big`` is then neither shuffled nor skewed; beyond it the
    join is shuffled with ``big``'s hot keys split.
    """
    from tessera.core import fits_broadcast

    if fits_broadcast(big.sparkSession, small_bound):
        return big.join(F.broadcast(small), keys, "inner")
    return salted_join(big, small, keys, split_right=False)


_SALT = "_salt"
_NS = "_nsplit"


def prepare_repeated_join(big: DataFrame, keys: list[str], num_partitions: int | None = None):
    """Salt a fixed big side once for many joins with a changing small side.

    Returns ``(big_salted, hot)``: ``big_salted`` carries a ``_salt`` column
    and is hash-partitioned on ``keys + [_salt]`` (persist it), ``hot`` is the
    hot-key table (or ``None``; then ``big`` is partitioned on ``keys`` alone
    and has no salt column).  Each later :func:`join_prepared` then
    shuffles only the small side; the big side's partitioning is reused.
    """
    spark = big.sparkSession
    threshold = conf_int(spark, CONF_HOT_KEY_ROWS)
    max_hot = conf_int(spark, CONF_MAX_HOT_KEYS)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = _hottest(_hot_counts(big, keys, threshold, _NS), [_NS], max_hot)
    if hot is None:
        # No hot key: partition on the keys alone (a constant salt would be
        # folded out of the join keys and the partitioning not reused).
        return big.repartition(n, *keys), None
    cols = [F.col(c) for c in big.columns]
    salted = (
        big.join(hot, keys, "left")
        .withColumn(_SALT, F.pmod(F.xxhash64(*cols), F.coalesce(F.col(_NS), F.lit(1)).cast("long")))
        .drop(_NS)
    )
    return salted.repartition(n, *keys, _SALT), hot


def join_prepared(big_salted: DataFrame, hot, small_side: DataFrame, keys: list[str]) -> DataFrame:
    """Join a side prepared by :func:`prepare_repeated_join` with a small side
    whose keys are unique; the small side is replicated once per split."""
    if hot is None:
        return big_salted.join(small_side, keys, "inner")
    splits = (F.coalesce(F.col(_NS), F.lit(1)) - 1).cast("long")
    rep = (
        small_side.join(hot, keys, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("long"), splits)))
        .drop(_NS)
    )
    return big_salted.join(rep, keys + [_SALT], "inner").drop(_SALT)
