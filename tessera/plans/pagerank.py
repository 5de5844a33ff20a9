"""Transition matrix and PageRank.

``x <- alpha * P x + (1 - alpha) * v`` for a fixed number of iterations, no
convergence test and no dangling-node correction (mass of nodes without
out-edges leaks, as in the original).

Plan per iteration: one join of the persisted transition matrix with ``x``
on the source index and one partial-aggregated sum by destination.

* ``x`` fits the broadcast limit (its size is the proven bound): ``x`` is
  broadcast, ``P`` is streamed from cache, only partial sums are shuffled.
* otherwise ``P`` is written once as a table bucketed by source and the iterate,
  whose sums come out of a shuffle on the same index, stays in the same partitions:
  the join moves neither side, and an iteration's only shuffle is that of its
  pre-aggregated sums.  The few hot sources (a hub with a third of all edges) are kept apart:
  their edges stay where they are and the hubs' values, at most ``maxHotKeys`` rows, are broadcast.

The iterate is cut from its lineage every few iterations and after the last one
(written to ``spark.checkpoint.dir``; bucketed in the second form, so the cut
keeps its partitions), so a lost executor recomputes at most that many steps, the plan
never grows, and what was cached or written for ``P`` is released before returning.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Mat, Vec, canon, cut_bucketed, cut_lineage, drop_lineage, fits_broadcast, shuffle_partitions
from tessera.operators.aggregates import out_degree_weights
from tessera.plans.skew import hot_keys
from tessera.sources.entries import from_entries, ones_vector


def transition_matrix(edges: DataFrame, n: int | None = None, src: str = "src", dst: str = "dst") -> Mat:
    """Entry ``(dst, src, count/outdeg(src))``; square, size ``n`` (or
    max index + 1).  Duplicate edges count in the degree and are summed."""
    w = out_degree_weights(edges, src, dst)
    e = w.select(F.col(dst).alias("i"), F.col(src).alias("j"), F.col("w").alias("v"))
    if n is None:
        r = edges.agg(F.max(src).alias("a"), F.max(dst).alias("b")).first()
        n = int(max(r["a"] or 0, r["b"] or 0)) + 1
    return from_entries(e, n, n)


def pagerank(
    P: Mat,
    alpha: float = 0.85,
    iterations: int = 10,
    x0: Vec | None = None,
    v: Vec | None = None,
    checkpoint_every: int = 3,
    num_partitions: int | None = None,
) -> Vec:
    """Damped power iteration; ``x0 = v = ones`` by default (the
    application form).  Pass ``x0 = v = 1/n`` for the normalised form."""
    spark = P.spark
    n = P.nrows
    x = x0 if x0 is not None else ones_vector(spark, n)
    v = v if v is not None else ones_vector(spark, n)
    teleport = v.df.select("i", (F.col("v") * F.lit(1.0 - alpha)).alias("v"))
    scaled = P.df.select("i", "j", (F.col("v") * F.lit(alpha)).alias("pv"))
    steps = _InMemory(scaled) if fits_broadcast(spark, n) else _CoPartitioned(scaled, num_partitions)

    now, kept = steps.begin(x.df.select("i", "v")), None
    for it in range(iterations):
        now = canon(steps.terms(now).unionByName(teleport).groupBy("i").agg(F.sum("v").alias("v")))
        if it + 1 == iterations or (checkpoint_every and (it + 1) % checkpoint_every == 0):
            now = cut_lineage(now) if it + 1 == iterations else steps.cut(now)
            if kept is not None:
                drop_lineage(kept)
            kept = now
    # The result is read back from the checkpoint folder: what was kept for P goes.
    if iterations:
        steps.release()
    return Vec(now, n)


class _InMemory:
    """``P x`` with P cached in place and the iterate broadcast."""

    def __init__(self, P: DataFrame):
        self.P = P.persist(StorageLevel.MEMORY_AND_DISK)

    def begin(self, x: DataFrame) -> DataFrame:
        return x

    cut = staticmethod(cut_lineage)

    def terms(self, x: DataFrame) -> DataFrame:
        """``(i, v)``: the products to be summed by ``i``."""
        xs = x.select(F.col("i").alias("j"), F.col("v").alias("xv"))
        return self.P.join(F.broadcast(xs), "j").select("i", (F.col("pv") * F.col("xv")).alias("v"))

    def release(self) -> None:
        self.P.unpersist()


class _CoPartitioned:
    """``P x`` with P and the iterate bucketed alike; hot sources' values are broadcast to their edges."""

    def __init__(self, P: DataFrame, num_partitions: int | None = None):
        self.parts = num_partitions or shuffle_partitions(P.sparkSession)
        self.hot = hot_keys(P, ["j"])
        rest, self.hubs = P, None
        if self.hot is not None:
            rest = P.join(self.hot, "j", "left_anti")
            self.hubs = cut_lineage(P.join(self.hot, "j", "left_semi"))
        self.P = cut_bucketed(rest, self.parts, "j")
        self.first: DataFrame | None = None

    def begin(self, x: DataFrame) -> DataFrame:
        self.first = cut_bucketed(x, self.parts, "i")
        return self.first

    def cut(self, x: DataFrame) -> DataFrame:
        return cut_bucketed(x, self.parts, "i")

    def terms(self, x: DataFrame) -> DataFrame:
        xs = x.select(F.col("i").alias("j"), F.col("v").alias("xv"))
        product = (F.col("pv") * F.col("xv")).alias("v")
        out = self.P.join(xs.hint("merge"), "j").select("i", product)
        if self.hubs is not None:
            few = F.broadcast(xs.join(self.hot, "j", "left_semi"))  # a row a hot source
            out = out.unionByName(self.hubs.join(few, "j").select("i", product))
        return out

    def release(self) -> None:
        for table in (self.P, self.hubs, self.first):
            if table is not None:
                drop_lineage(table)


def pagerank_from_edges(edges: DataFrame, n: int | None = None, **kw) -> Vec:
    return pagerank(transition_matrix(edges, n), **kw)
