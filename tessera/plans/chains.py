"""Matrix chain products.

Catalyst cannot reorder a chain of products (an aggregate sits between
every two joins), so the bracket is chosen here: either given by the user
(P9) or greedily from sampled block counts (P10), re-sampling each product
as it is formed.  The decision needs only small count tables (one row per
sampled block); the products themselves are ordinary J6 plans.

:func:`chain_estimated` costs every bracket before anything is multiplied:
ranks of columns, passed down the matrices as minima, estimate how many cells
each row and column of every partial chain will store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import Mat, cut_lineage, idiv, require
from tessera.operators.aggregates import _sampled_blocks
from tessera.operators.algebra import matmul
from tessera.operators.elementwise import transpose
from tessera.plans.skew import salted_join


def parse_bracket(spec: str, n: int):
    """Parse a bracket such as ``"(AB)(CD)"`` or ``"A(B(CD))"`` over the first
    ``n`` letters into a nested tuple of indices."""
    tokens = [c for c in spec if not c.isspace()]
    pos = 0

    def term():
        nonlocal pos
        items = []
        while pos < len(tokens) and tokens[pos] != ")":
            c = tokens[pos]
            if c == "(":
                pos += 1
                items.append(term())
                require(pos < len(tokens) and tokens[pos] == ")", "unbalanced bracket")
                pos += 1
            else:
                idx = ord(c.upper()) - ord("A")
                require(0 <= idx < n, f"unknown operand {c}")
                items.append(idx)
                pos += 1
        require(len(items) > 0, "empty bracket")
        node = items[0]
        for it in items[1:]:
            node = (node, it)
        return node

    tree = term()
    require(pos == len(tokens), "unbalanced bracket")
    return tree


def chain_multiply(mats: list[Mat], bracket: str) -> Mat:
    """Product of ``mats`` in the user's bracket (left-to-right within a
    bracket level), e.g. ``"((AB)C)D"``, ``"(AB)(CD)"``, ``"A(B(CD))"``."""
    tree = parse_bracket(bracket, len(mats))

    def ev(node):
        if isinstance(node, int):
            return mats[node]
        return matmul(ev(node[0]), ev(node[1]))

    return ev(tree)


def _block_counts(mats: list[tuple[Mat, float]], block: int) -> list[DataFrame]:
    """A7 on both axes in one pass per matrix: ``(axis, blk, n)``, sampled nnz per row block and
    per column block.  The counts of all ``(matrix, ratio)`` are written as one table to the
    checkpoint folder."""

    def sampled(axis: str, idx: str, dim: int, ratio: float) -> Column:
        n_sampled, step = _sampled_blocks(-(-dim // block), ratio)
        b = idiv(F.col(idx), F.lit(block))
        keep = (F.pmod(b, F.lit(step)) == 0) & (idiv(b, F.lit(step)) < F.lit(n_sampled))
        return F.when(keep, F.struct(F.lit(axis).alias("axis"), b.alias("blk")))

    out = None
    for k, (m, ratio) in enumerate(mats):
        both = F.array_compact(F.array(sampled("row", "i", m.nrows, ratio), sampled("col", "j", m.ncols, ratio)))
        cells = m.df.select(F.explode(both).alias("s"))
        counts = cells.groupBy("s.axis", "s.blk").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit(k))
        out = counts if out is None else out.unionByName(counts)
    table = cut_lineage(out)
    return [table.filter(F.col("m") == k).drop("m") for k in range(len(mats))]


def _pair_costs(pairs: list[tuple[DataFrame, DataFrame]]) -> list[int]:
    """A8 on sampled blocks for several pairs: ``sum_k nnz(A col-block k) * nnz(B row-block k)``,
    summed in Spark; one row per pair reaches the driver."""
    out = None
    for k, (a, b) in enumerate(pairs):
        ca = a.filter("axis = 'col'").select("blk", F.col("n").alias("na"))
        cb = b.filter("axis = 'row'").select("blk", F.col("n").alias("nb"))
        cost = F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).cast("long")
        one = ca.join(cb, "blk").agg(cost.alias("cost")).withColumn("pair", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return [r["cost"] for r in sorted(out.collect(), key=lambda r: r["pair"])]


def chain_cost_ordered(
    mats: list[Mat], block: int = 100, ratio: float = 0.01, product_ratio: float = 0.1
) -> tuple[Mat, str]:
    """P10: greedy bracket: repeatedly multiply the adjacent pair with the
    smallest sampled cost (first one on ties); a formed product is sampled
    with ``product_ratio``.  Returns the product and the bracket used.

    Inputs and formed products are read several times (both axes' counts, then
    the product), so each is written once to the checkpoint folder.
    """
    require(len(mats) >= 1, "empty chain")

    def cut(m: Mat) -> Mat:
        return Mat(cut_lineage(m.df), m.nrows, m.ncols)

    if len(mats) < 3:
        product = mats[0] if len(mats) == 1 else matmul(mats[0], mats[1])
        return product, "AB"[: len(mats)]
    inputs = [cut(m) for m in mats]
    counts = _block_counts([(m, ratio) for m in inputs], block)
    items = [(m, chr(ord("A") + k), c) for k, (m, c) in enumerate(zip(inputs, counts))]
    costs = _pair_costs([(a[2], b[2]) for a, b in zip(items, items[1:])])
    while len(items) > 2:
        k = costs.index(min(costs))
        (a, name_a, _), (b, name_b, _) = items[k], items[k + 1]
        product = cut(matmul(a, b))
        items[k : k + 2] = [(product, f"({name_a}{name_b})", *_block_counts([(product, product_ratio)], block))]
        # Only the pairs around the product are new.
        costs[k : k + 1] = []
        new = [x for x in (k - 1, k) if 0 <= x < len(costs)]
        for x, cost in zip(new, _pair_costs([(items[x][2], items[x + 1][2]) for x in new])):
            costs[x] = cost
    (a, name_a, _), (b, name_b, _) = items
    return matmul(a, b), name_a + name_b


RANKS = 64  # ranks of an index; a row's estimate has a relative error of about 1 / sqrt(RANKS - 2)
_SEED = 1009


def _column_share(t: int) -> Column:
    """Share ``t`` of column ``j``, uniform on (0, 1); its rank is ``-log`` of it, and the least rank of a set of columns tells
    how many there are."""
    steps = 1 << 52
    return (F.pmod(F.xxhash64("j", F.lit(t), F.lit(_SEED)), F.lit(steps)) + F.lit(0.5)) / F.lit(float(steps))


def _row_ranks(m: Mat, below: DataFrame | None, ranks: int) -> DataFrame:
    """``(k, f)``: for every row of ``m`` the least ranks of the columns it reaches, through the rows ``below`` of the product that
    follows (None: its own columns)."""
    if below is None:  # the least rank is that of the greatest share
        reached = m.df.select("i", "j")
        least = [-F.log(F.max(_column_share(t))) for t in range(ranks)]
    else:
        reached = salted_join(m.df.select("i", F.col("j").alias("k")), below, ["k"], split_right=False).select("i", "f")
        least = [F.min(F.col("f")[t]) for t in range(ranks)]
    return cut_lineage(reached.groupBy(F.col("i").alias("k")).agg(F.array(*least).alias("f")))


def _reached(ranks: int) -> Column:
    """Estimated number of columns behind the least ranks ``f``."""
    return F.lit(ranks - 1.0) / F.aggregate("f", F.lit(0.0), lambda s, x: s + x)


class ChainSizes:
    """Estimated stored cells of every row and column of every partial chain, without forming a product.

    A row of ``A B`` reaches the columns that B's rows under its entries reach, so the least rank of its columns is the least
    of theirs: one pass over a matrix's entries per partial chain.  Columns take the same way through the transposes.
    """

    def __init__(self, mats: list[Mat], ranks: int = RANKS):
        self.mats, self.ranks = mats, ranks
        turned = [transpose(m) for m in mats]
        self.rows: dict[tuple[int, int], DataFrame] = {}
        self.cols: dict[tuple[int, int], DataFrame] = {}
        for q in range(len(mats)):
            for p in range(q, -1, -1):
                self.rows[p, q] = _row_ranks(mats[p], self.rows.get((p + 1, q)), ranks)
        for p in range(len(mats)):
            for q in range(p, len(mats)):
                self.cols[p, q] = _row_ranks(turned[q], self.cols.get((p, q - 1)), ranks)

    def nnz(self, p: int, q: int) -> float:
        """Stored cells of the product of matrices ``p`` to ``q``."""
        return self.rows[p, q].agg(F.coalesce(F.sum(_reached(self.ranks)), F.lit(0.0))).first()[0]

    def products(self, splits: list[tuple[int, int, int]]) -> list[float]:
        """Partial products of multiplying ``p..m`` by ``m+1..q`` for each ``(p, m, q)``; a row each reaches the driver."""
        out = None
        for n, (p, m, q) in enumerate(splits):
            left = self.cols[p, m].select("k", _reached(self.ranks).alias("l"))
            right = self.rows[m + 1, q].select("k", _reached(self.ranks).alias("r"))
            one = left.join(right, "k").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0.0)).alias("c")).withColumn("n", F.lit(n))
            out = one if out is None else out.unionByName(one)
        return [r["c"] for r in sorted(out.collect(), key=lambda r: r["n"])] if splits else []


def estimated_bracket(mats: list[Mat], ranks: int = RANKS) -> tuple[str, float]:
    """The bracket of least estimated partial products, over all brackets, and their number."""
    n = len(mats)
    sizes = ChainSizes(mats, ranks)
    splits = [(p, m, q) for width in range(1, n) for p in range(n - width) for q in [p + width] for m in range(p, q)]
    own = dict(zip(splits, sizes.products(splits)))
    best: dict[tuple[int, int], tuple[float, str]] = {(k, k): (0.0, chr(ord("A") + k)) for k in range(n)}
    for p, _, q in splits:
        ways = [(best[p, m][0] + best[m + 1, q][0] + own[p, m, q], f"({best[p, m][1]}{best[m + 1, q][1]})") for m in range(p, q)]
        best[p, q] = min(ways)
    cost, bracket = best[0, n - 1]
    return bracket[1:-1] if n > 1 else bracket, cost


def chain_estimated(mats: list[Mat], ranks: int = RANKS) -> tuple[Mat, str]:
    """P10 with every bracket costed beforehand (:func:`estimated_bracket`).  Returns the product and the bracket used.
    The inputs are read several times, so each is written once to the checkpoint folder."""
    require(len(mats) >= 1, "empty chain")
    inputs = [Mat(cut_lineage(m.df), m.nrows, m.ncols) for m in mats]
    bracket, _ = estimated_bracket(inputs, ranks)
    return chain_multiply(inputs, bracket), bracket
