"""Cells drawn in numpy against those of the generators' own tables, and what is formed of them against joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import mat_from_dense
from tessera.operators import algebra as J
from tessera.plans import generated as G
from tessera.sources import entries as S


@pytest.fixture(params=[5, 1 << 14])
def buffers(request, monkeypatch):
    monkeypatch.setattr(G, "DRAWN_CELLS", request.param)


def with_nulls(spark, shape, seed=12):
    """A sparse matrix with entries of NULL indices."""
    rng = np.random.default_rng(seed)
    a = (rng.random(shape) < 0.3) * rng.integers(1, 5, shape).astype(float)
    a[1, 2] = np.inf
    null = spark.createDataFrame([(None, 4, 2.0), (3, None, 1.5), (None, None, 1.0)], "i LONG, j LONG, v DOUBLE")
    return J.Mat(mat_from_dense(spark, a).df.unionByName(null), *shape)


def test_hashes_are_sparks(spark):
    x = np.array([0, 1, 7, -1, 2**40 + 3, -(2**62), 2**63 - 1])
    rows = spark.createDataFrame([(int(v),) for v in x], "x LONG")
    for seed in (7, -3, 5 + G._GOLDEN, 1 << 40):
        want = [r[0] for r in rows.select(F.xxhash64(F.lit(seed), "x")).collect()]
        with np.errstate(over="ignore"):
            assert G.hash_long(x, G.hash_seed(seed)).view(np.int64).tolist() == want
    with np.errstate(over="ignore"):
        assert G._line_offsets(x, 11).tolist() == [r[0] for r in rows.select(F.xxhash64("x", F.lit(11))).collect()]


@pytest.mark.parametrize("shape", [(12, 9), (1, 50), (97, 7)])
def test_drawn_cells_are_the_generators(spark, buffers, shape):
    for m in (S.rand_matrix(spark, *shape, 1.0, 2.0, seed=3), S.randn_matrix(spark, *shape, seed=5)):
        want = {(r.j, r.i): r.v for r in m.df.collect()}
        got = np.concatenate(list(m.cells.drawn(np.arange(shape[1])))).reshape(shape[1], shape[0])
        np.testing.assert_allclose(got, [[want[j, i] for i in range(shape[0])] for j in range(shape[1])], rtol=1e-12)
    for normal in (False, True):
        m = S.sprand(spark, *shape, 0.4, seed=9, normal=normal)
        got = {(int(i), j): v for j, (rows, values) in enumerate(m.cells.drawn(np.arange(shape[1]))) for i, v in zip(rows, values)}
        assert got == pytest.approx({(r.i, r.j): r.v for r in m.df.collect()}, rel=1e-12)
    m = S.skewed_sparse(spark, *shape, 0.3, 0.4 if shape[0] > 1 else 1.0)
    drawn = [(line, int(j), v) for line, at, values in m.cells.drawn(np.arange(shape[0])) for j, v in zip(at, values)]
    assert len(drawn) == len({d[:2] for d in drawn})
    assert {d[:2]: d[2] for d in drawn} == {(r.i, r.j): r.v for r in m.df.collect()}


@pytest.mark.parametrize("parts", [1, 4])
def test_stored_cells_beside_sums_and_products(spark, buffers, parts):
    q = with_nulls(spark, (12, 9))
    noise = S.randn_matrix(spark, 12, 9, seed=5)
    for m in (J.add(q, noise, every_cell=True), J.elementwise_multiply(q, S.rand_matrix(spark, 12, 9, 1.0, 2.0, seed=3))):
        got = J.beside_stored(m, parts)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        want = m.df.join(q.df.select("i", "j", F.col("v").alias("q")), ["i", "j"]).collect()
        assert {(r.i, r.j): (r.v, r.q) for r in got.collect()} == {(r.i, r.j): (pytest.approx(r.v, rel=1e-12), r.q) for r in want}
        assert got.count() == len(want) > 20
    # A sum that is zero is not stored.
    first = noise.df.filter("i = 2 and j = 3").first().v
    near = next(iter(S.DenseCells(12, 9, 5, True).drawn(np.array([3]))))[2] if G.DRAWN_CELLS > 12 else first
    gone = J.Mat(spark.createDataFrame([(2, 3, -float(near)), (4, 4, 1.0)], "i LONG, j LONG, v DOUBLE"), 12, 9)
    if G.DRAWN_CELLS > 12:
        assert [(r.i, r.j) for r in J.beside_stored(J.add(gone, noise, every_cell=True), parts).collect()] == [(4, 4)]
    with pytest.raises(ValueError):
        J.beside_stored(q, parts)


def test_mask_is_counted_where_it_is_drawn(spark, buffers):
    q = with_nulls(spark, (12, 9))
    for normal in (False, True):
        m = S.sprand(spark, 12, 9, 0.4, seed=9, normal=normal)
        flagged = q.df.selectExpr("i", "j", "1 q", "0 m").unionByName(m.df.selectExpr("i", "j", "0 q", "1 m"))
        want = flagged.groupBy("i", "j").agg(F.sum("q").alias("q"), F.sum("m").alias("m")).selectExpr("sum(m)", "sum(q)", "max(m)", "count_if(m * q = 1)").first()
        got = G.mask_counts(q.df, m.cells, 4)
        assert tuple(got.selectExpr("sum(mask)", "sum(q_nnz)", "max(most)", "sum(under)").first()) == tuple(want)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_lines_are_counted_where_they_are_drawn(spark, buffers):
    q = with_nulls(spark, (12, 9))
    q = J.Mat(q.df.withColumn("v", F.when(F.col("j") == 4, -F.col("v")).otherwise(F.col("v"))), 12, 9)
    g = S.skewed_sparse(spark, 12, 9, 0.4, 0.5)
    both = g.df.join(q.df.select("i", "j", F.col("v").alias("q")), ["i", "j"]).selectExpr("i", "v * q v", "q").filter("not (v > 0 and v <= q)")
    rows = [m.selectExpr("i", *[f"{int(n == k)} c{n}" for n in range(3)]) for k, m in enumerate((g.df, q.df, both))]
    want = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("i").agg(F.sum("c0"), F.sum("c1"), F.sum("c2")).collect()
    got = G.line_counts(q.df, g.cells, 12, 4, lambda v, q: ~((v * q > 0) & (v * q <= q))).collect()
    key = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
    assert sum(r[3] for r in got) > 0
