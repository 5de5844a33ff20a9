"""Kruskal-Wallis association tests between expression and genotype.

Inputs are long tables: expression ``(gene, sample, v)`` (NULL = missing)
and genotype ``(snp, sample, g)`` with ``g`` in {0, 1, 2} (NULL = missing).

For every (gene, SNP):  ``H = 12 / (K (K + 1)) * sum_l S_l^2 / N_l - 3 (K + 1)``
where ``S_l`` is the sum of the expression ranks of the samples with
genotype ``l`` and ``N_l`` their count; an empty group adds 0; no tie
correction.  Results are dense: a statistic of exactly 0 is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.core import Mat, canon, idiv, require, ship_package
from tessera.plans import tiles
from tessera.plans.skew import join_by_bound, ranks


def _stat(k, s0, n0, s1, n1, s2, n2):
    def term(s, n):
        return F.when(n > 0, s * s / n).otherwise(F.lit(0.0))

    k = k.cast("double")
    return F.lit(12.0) / (k * (k + 1)) * (term(s0, n0) + term(s1, n1) + term(s2, n2)) - F.lit(3.0) * (k + 1)


def _require_complete(table: DataFrame, key: str, n_keys: int, n_samples: int) -> None:
    """Every one of ``n_keys`` keys has ``n_samples`` rows."""
    per_key = table.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    r = per_key.agg(F.count(F.lit(1)).alias("keys"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    complete = (r["keys"], r["lo"], r["hi"]) == (n_keys, n_samples, n_samples) or n_keys == 0 == r["keys"]
    require(complete, f"{r['keys']} of {n_keys} values of {key} with {r['lo']} to {r['hi']} of {n_samples} samples")


def kruskal_wallis(
    expr: DataFrame,
    geno: DataFrame,
    n_genes: int,
    n_snps: int,
    n_samples: int,
) -> DataFrame:
    """Complete expression table; a missing genotype is coded 0.

    Every gene needs a value and every SNP a row for each of the ``n_samples``
    samples (one aggregate each); an incomplete table raises.  P4 takes
    tables with missing values.

    Plan: ranks per gene (skew-safe, W1), then one product of dense tiles
    (:mod:`tessera.plans.tiles`): a block of genes meets a block of SNPs over a
    chunk of samples, and two matrix products give the rank sums of genotypes
    1 and 2.  Chunks' sums are added by Spark.  Group 0 follows from the totals:
    ``S_0 = K(K+1)/2 - S_1 - S_2``, ``N_0 = K - N_1 - N_2``.
    """
    K = n_samples
    _require_complete(expr.filter(F.col("v").isNotNull()), "gene", n_genes, K)
    _require_complete(geno, "snp", n_snps, K)
    r = ranks(expr.select("gene", "sample", "v"), ["gene"], "v", "sample")
    left = r.select(F.col("gene").alias("r"), F.col("sample").alias("k"), F.col("rank_avg").alias("v"))
    right = geno.select(F.col("snp").alias("r"), F.col("sample").alias("k"), F.coalesce(F.col("g").cast("int"), F.lit(0)).alias("v"))
    tl, tr = tiles.Tiling.of(n_genes, K), tiles.Tiling.of(n_snps, K)
    pairs = tiles.tile_pairs(tiles.dense_tiles(left, tl, np.float64), tiles.dense_tiles(right, tr, np.int8), tl, tr)

    def sums(a, b, chunk, x, y):
        rank, code = tl.cells(a, chunk, x, np.float64), tr.cells(b, chunk, y, np.int8)
        level = [(code == g).astype(np.float64) for g in (1, 2)]
        n = [z.sum(axis=1) for z in level]
        snp = np.arange(len(code)) + b * tr.rows
        for s in tiles.slabs(len(rank), len(code)):
            gene = np.arange(s.start, s.stop) + a * tl.rows
            part = {"gene": np.repeat(gene, len(snp)), "snp": np.tile(snp, len(gene))}
            part |= {f"s{g}": (rank[s] @ z.T).ravel() for g, z in zip((1, 2), level)}
            yield part | {f"n{g}": np.tile(x, len(gene)) for g, x in zip((1, 2), n)}

    names = ["s1", "s2", "n1", "n2"]
    t = tiles.per_pair(pairs, "gene long, snp long, s1 double, s2 double, n1 double, n2 double", sums, tiles.TILE_CELLS)
    if tl.chunks > 1:
        t = t.groupBy("gene", "snp").agg(*[F.sum(c).alias(c) for c in names])
    s1, s2, n1, n2 = (F.col(c) for c in names)
    s0 = F.lit(K * (K + 1) / 2.0) - s1 - s2
    n0 = F.lit(float(K)) - n1 - n2
    return t.select("gene", "snp", _stat(F.lit(K), s0, n0, s1, n1, s2, n2).alias("stat"))


TILE_CELLS = 1_000_000  # expression values of a piece of genes; genotype calls of an SNP block
MISSING = -1
_LEVELS = (0, 1, 2)


def kruskal_wallis_missing(
    expr: DataFrame,
    geno: DataFrame,
    n_snps: int,
    n_samples: int,
    tile_cells: int = TILE_CELLS,
) -> DataFrame:
    """Complete-pair test (R17).  For each (gene, SNP) only samples with
    both an expression value and a genotype call count: ranks are taken
    among them (ties averaged), ``K`` is their number.  Pairs without any
    complete sample produce no row.

    Plan: genes are gathered into pieces of about ``tile_cells`` values, SNPs into
    blocks of ``tile_cells`` calls (one byte each; a block has at least one SNP), and every
    piece meets every block by an equi-join on the block's id.  A pair is ranked
    in numpy (:func:`_piece_sums`), so what is shuffled is the two inputs, never a
    row per (gene, SNP, sample).  A gene with more values than a piece is cut by
    ranges of its values (:func:`_pieces`): a range gives each SNP's counts and the
    rank sums within it, and the counts of the ranges below shift its ranks
    (:func:`_merged`).
    """
    ship_package(expr.sparkSession)
    pieces = _pieces(expr.filter(F.col("v").isNotNull()).select("gene", "sample", "v"), n_samples, tile_cells)
    per_block = max(1, tile_cells // max(1, n_samples))
    tiling = tiles.Tiling(n_snps, n_samples, max(1, min(n_snps, per_block)), max(1, min(n_samples, tile_cells)))
    calls = geno.filter(F.col("g").isNotNull()).select(F.col("snp").alias("r"), F.col("sample").alias("k"), F.col("g").alias("v"))
    blocks = (
        tiles.dense_tiles(calls, tiling, np.int8, MISSING)
        .groupBy("block")
        .agg(F.collect_list(F.struct("chunk", "cells")).alias("part"))
        .select(F.col("block").alias("_b"), F.col("part.chunk").alias("chunks"), F.col("part.cells").alias("cells"))
    )
    ids = F.sequence(F.lit(0).cast("long"), F.lit(max(1, tiling.blocks) - 1).cast("long"))
    pairs = join_by_bound(pieces.withColumn("_b", F.explode(ids)), blocks, ["_b"], n_snps * n_samples)
    tiles.few_rows_a_batch(pairs, 4 * max(tile_cells, n_samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                at = {c: batch.column(c)[n].values.to_numpy() for c in ("gene", "sample", "v", "chunks")}
                block, cells = batch.column("_b")[n].as_py(), batch.column("cells")[n].values
                code = np.full((tiling.height(block), n_samples), MISSING, np.int8)
                for c, data in zip(at["chunks"].tolist(), cells):
                    code[:, c * tiling.chunk : (c + 1) * tiling.chunk] = tiling.cells(block, c, data.as_buffer(), np.int8)
                snp = np.arange(len(code)) + block * tiling.rows
                tied = batch.column("tied")[n].as_py()
                for gene, sums in _piece_sums(code.T, at["gene"], at["sample"], at["v"], tied):
                    has = np.flatnonzero(sum(sums[f"n{g}"] for g in _LEVELS))
                    columns = {"gene": np.full(len(has), gene), "snp": snp[has], "start": np.full(len(has), batch.column("start")[n].as_py()), "tied": np.full(len(has), tied)}
                    yield pa.RecordBatch.from_pydict(columns | {c: x[has] for c, x in sums.items()})

    sums = pairs.select("_b", "start", "tied", "gene", "sample", "v", "chunks", "cells").mapInArrow(run, f"gene long, snp long, start long, tied boolean, {_SUMS}")
    if n_samples > tile_cells:  # else a gene is one piece, whose sums are final
        sums = _merged(sums)
    n = [F.col(f"n{g}") for g in _LEVELS]
    return sums.select("gene", "snp", _stat(n[0] + n[1] + n[2], *[c for g in _LEVELS for c in (F.col(f"s{g}"), n[g].cast("double"))]).alias("stat"))


_SUMS = ", ".join(f"n{g} long, s{g} double" for g in _LEVELS)


def _pieces(expr: DataFrame, n_samples: int, tile_cells: int) -> DataFrame:
    """``(block, start, tied, part, gene, sample, v)``, the last three as arrays of about ``tile_cells`` values.

    Genes of at most ``tile_cells`` samples are gathered by blocks.  Else every gene is cut where its ranks
    pass a multiple of ``tile_cells``, so that tied values stay together; a run of ties that is longer is a range of
    its own (``tied``) and may be cut anywhere, since it adds counts only.
    """
    per_block = max(1, tile_cells // max(1, n_samples))
    keys = {"block": idiv(F.col("gene"), F.lit(per_block)), "start": F.lit(0).cast("long"), "tied": F.lit(False), "part": F.lit(0).cast("long")}
    if n_samples > tile_cells:
        expr = ranks(expr, ["gene"], "v", "sample")
        low = F.col("rank_min").cast("long") - 1
        ties = (2 * (F.col("rank_avg") - F.col("rank_min")) + 1).cast("long")
        parts = F.when(ties > tile_cells, F.ceil(ties / tile_cells)).otherwise(F.lit(1)).cast("long")
        keys["start"] = idiv(low, F.lit(tile_cells)) * tile_cells
        keys["tied"] = ties > tile_cells
        keys["part"] = F.pmod(F.xxhash64("sample"), parts)
    gathered = expr.groupBy(*[e.alias(c) for c, e in keys.items()]).agg(F.collect_list(F.struct("gene", "sample", "v")).alias("e"))
    return gathered.select("start", "tied", *[F.col(f"e.{c}").alias(c) for c in ("gene", "sample", "v")])


def _piece_sums(code: np.ndarray, gene, sample, v, tied: bool):
    """``(gene, columns of _SUMS)`` for each gene of a piece: by genotype, each SNP's count of called samples and the sum of
    their ranks among the piece's called samples (0 for a piece of tied values, whose ranks follow from all its parts).

    The samples of a gene in ascending order of value form tie groups; a
    tie group's rank for an SNP follows from how many of its samples, and
    of those before it, have a call.  ``code``: samples x SNPs.
    """
    by_gene = np.argsort(gene, kind="stable")
    for mine in np.split(by_gene, np.flatnonzero(np.diff(gene[by_gene])) + 1):
        order = mine[np.argsort(v[mine], kind="stable")]
        value, called = v[order], code[sample[order]]
        start = np.array([0]) if tied else np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        per_group = [np.add.reduceat(called == level, start, axis=0, dtype=np.int64) for level in _LEVELS]
        count = sum(per_group)
        rank = np.cumsum(count, axis=0) - count + (count + 1) / 2.0
        out = {}
        for g, x in zip(_LEVELS, per_group):
            out[f"n{g}"], out[f"s{g}"] = x.sum(axis=0), np.zeros(x.shape[1]) if tied else (rank * x).sum(axis=0)
        yield gene[mine[0]], out


def _merged(sums: DataFrame) -> DataFrame:
    """Sums of whole (gene, SNP) pairs from those of their ranges; one shuffle on the pair.  Ranks within a range move up by the
    called samples of the ranges below."""
    by_pair = sums.repartition("gene", "snp")
    ranges = by_pair.groupBy("gene", "snp", "start", "tied").agg(*[F.sum(f"{c}{g}").alias(f"{c}{g}") for g in _LEVELS for c in "ns"])
    n = F.col("n0") + F.col("n1") + F.col("n2")
    below = Window.partitionBy("gene", "snp").orderBy("start", "tied").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("below", F.coalesce(F.sum(n).over(below), F.lit(0)))
    within = lambda g: F.when(F.col("tied"), F.col(f"n{g}") * (n + 1) / 2.0).otherwise(F.col(f"s{g}"))
    return ranges.groupBy("gene", "snp").agg(
        *[F.sum(f"n{g}").alias(f"n{g}") for g in _LEVELS],
        *[F.sum(within(g) + F.col(f"n{g}") * F.col("below")).alias(f"s{g}") for g in _LEVELS],
    )


def eqtl_product(expr: Mat, geno: Mat) -> Mat:
    """P5: expression x genotypeᵀ (genes x SNPs), a product of dense tiles."""
    require(expr.ncols == geno.ncols, "sample counts differ")
    side = lambda m: m.df.select(F.col("i").alias("r"), F.col("j").alias("k"), "v")
    return Mat(canon(tiles.product(side(expr), side(geno), expr.nrows, geno.nrows, expr.ncols)), expr.nrows, geno.nrows)
