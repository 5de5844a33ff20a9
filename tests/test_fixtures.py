"""Worked examples with known answers (FIXTURES.md F1-F12)."""

# The inputs F1-F8 and their results are given; the test code is not.

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import dense, dense_vec, mat_from_dense, vec_from_dense
from tessera.operators import aggregates as A
from tessera.operators import algebra as J
from tessera.operators import elementwise as E
from tessera.operators import ranking as W
from tessera.operators import reshape as X
from tessera.plans import eqtl as Q
from tessera.plans import factorization as FZ
from tessera.plans import pagerank as PR
from tessera.sources import entries as S

A6 = np.array([[6 * i + j + 1 for j in range(6)] for i in range(6)], dtype=float)
B6 = np.array([[1, 1, 1, 2, 2, 2]] * 3 + [[3, 3, 3, 4, 4, 4]] * 3, dtype=float)


def test_f1_add_multiply_rowsums(spark):
    a, b = mat_from_dense(spark, A6), mat_from_dense(spark, B6)
    np.testing.assert_allclose(dense(J.add(a, b))[0], [2, 3, 4, 6, 7, 8])
    np.testing.assert_allclose(dense(J.add(a, b))[5], [34, 35, 36, 38, 39, 40])
    ab = J.matmul(a, b)
    expect = np.array([[51] * 3 + [72] * 3, [123] * 3 + [180] * 3, [195] * 3 + [288] * 3,
                       [267] * 3 + [396] * 3, [339] * 3 + [504] * 3, [411] * 3 + [612] * 3], dtype=float)
    np.testing.assert_allclose(dense(ab), expect)
    np.testing.assert_allclose(dense_vec(A.row_sums(ab)), [369, 909, 1449, 1989, 2529, 3069])


def test_f2_rank_one_and_vec(spark):
    a = mat_from_dense(spark, A6)
    x = vec_from_dense(spark, np.arange(1, 7))
    r = dense(J.rank_one_update(a, x))
    np.testing.assert_allclose(r[0], [2, 4, 6, 8, 10, 12])
    np.testing.assert_allclose(r[5], [37, 44, 51, 58, 65, 72])
    v = dense_vec(X.vec(J.rank_one_update(a, x)))
    np.testing.assert_allclose(v[:8], [2, 9, 16, 23, 30, 37, 4, 12])


def test_f3_outer_products(spark):
    x, y = vec_from_dense(spark, [1, 2, 1, 2]), vec_from_dense(spark, [3, 4, 3, 4])
    np.testing.assert_allclose(dense(J.outer_product(x, y)), [[3, 4, 3, 4], [6, 8, 6, 8], [3, 4, 3, 4], [6, 8, 6, 8]])
    ones = mat_from_dense(spark, np.ones((2, 2)))
    b = mat_from_dense(spark, [[2, 2, 3, 3, 4, 4, 5, 5]] * 2)
    np.testing.assert_allclose(dense(J.matmul_outer(ones, b)), [[4, 4, 6, 6, 8, 8, 10, 10]] * 2)


S1 = np.array([[1, 0, 4], [0, 3, 5], [2, 0, 6]], dtype=float)
S2 = np.array([[0, 1, 2], [3, 0, 0], [0, 2, 0]], dtype=float)


def test_f4_sparse_pair(spark):
    a, b = mat_from_dense(spark, S1), mat_from_dense(spark, S2)
    np.testing.assert_allclose(dense(J.matmul(a, b)), [[0, 9, 2], [9, 10, 0], [0, 14, 4]])
    had = J.elementwise_multiply(a, b)
    assert sorted(map(tuple, had.df.collect())) == [(0, 2, 8.0)]
    np.testing.assert_allclose(dense(J.add(a, b)), [[1, 1, 6], [3, 3, 5], [2, 2, 6]])
    np.testing.assert_allclose(dense(J.matmul(b, b.T)), [[5, 0, 2], [0, 9, 0], [2, 0, 4]])
    np.testing.assert_allclose(dense_vec(J.matvec(a, vec_from_dense(spark, [1, 2, 3]))), [13, 21, 20])
    np.testing.assert_allclose(dense(J.matmul(a, b.T)), [[8, 3, 0], [13, 0, 6], [12, 6, 0]])


def test_f5_divide_vector(spark):
    a = mat_from_dense(spark, [[1, 1, 1], [2, 2, 2], [3, 3, 3]])
    r = dense(J.divide_vector(a, vec_from_dense(spark, [1, 2, 3])))
    np.testing.assert_allclose(r, [[1, 0.5, 1 / 3], [2, 1, 2 / 3], [3, 1.5, 1]], rtol=1e-12)


def test_f6_sparse_vectors(spark):
    a = np.zeros(20)
    a[[0, 1, 2, 3]] = 1
    a[[11, 15, 16, 19]] = 2
    b = np.zeros(20)
    b[[1, 3, 6, 9]] = 2
    b[[10, 11, 12, 13]] = 1
    va, vb = vec_from_dense(spark, a), vec_from_dense(spark, b)
    assert J.inner(va, vb).first()[0] == 6.0
    assert J.inner(va, E.scale_vec(vb, 10)).first()[0] == 60.0  # ruling R1: both values used
    assert J.inner(va, S.ones_vector(spark, 20)).first()[0] == 12.0
    n = A.norms(va).first()
    assert n["l1"] == 12.0 and abs(n["l2"] - 4.472136) < 1e-6 and n["linf"] == 2.0


EDGES = [(0, d) for d in range(6)] + [(1, 0), (1, 2), (2, 3), (2, 4), (3, 1), (3, 2), (3, 4), (4, 5), (5, 4)]
F7 = [0.05451491, 0.05095178, 0.07270903, 0.06384132, 0.38606765, 0.37191531]
F7_NO_SELF = [0.04690616, 0.05132027, 0.07322643, 0.06429566, 0.38957735, 0.37467413]


@pytest.mark.parametrize("broadcast", [True, False])
def test_f7_pagerank(spark, broadcast):
    if not broadcast:
        spark.conf.set("tessera.broadcast.maxRows", "1")
        spark.conf.set("tessera.skew.hotKeyRows", "2")
    try:
        e = spark.createDataFrame(EDGES, "src BIGINT, dst BIGINT")
        P = PR.transition_matrix(e, 6)
        sixth = E.scale_vec(S.ones_vector(spark, 6), 1 / 6)
        x = PR.pagerank(P, 0.85, 10, x0=sixth, v=sixth, checkpoint_every=3)
        np.testing.assert_allclose(dense_vec(x), F7, atol=1e-7)
        x1 = PR.pagerank(P, 0.85, 10)
        np.testing.assert_allclose(dense_vec(x1), np.array(F7) * 6, atol=1e-6)
        e2 = e.filter(~((F.col("src") == 0) & (F.col("dst") == 0)))
        x2 = PR.pagerank(PR.transition_matrix(e2, 6), 0.85, 10, x0=sixth, v=sixth)
        np.testing.assert_allclose(dense_vec(x2), F7_NO_SELF, atol=1e-7)
    finally:
        spark.conf.unset("tessera.broadcast.maxRows")
        spark.conf.unset("tessera.skew.hotKeyRows")


def test_f8_rank_line(spark):
    vals = [0.220815, -0.003084, 0.120763, 0.130911, -0.133571, 0.173637, -0.075663, -0.276158, -0.331503, 0.415624]
    t = spark.createDataFrame([(0, j, v) for j, v in enumerate(vals)], "i BIGINT, j BIGINT, v DOUBLE")
    r = {row["j"]: row["rank"] for row in W.rank_rows_average(t).collect()}
    assert [r[j] for j in range(10)] == [9, 5, 6, 7, 3, 8, 4, 2, 1, 10]


def _kw_tables(spark, s0):
    expr = [(0, k, v) for k, v in enumerate([0.1, 0.5, 0.3, 0.9, 0.7, 0.2])] + [
        (1, k, float(v)) for k, v in enumerate([2, 2, 1, 3, 3, 3])
    ]
    s1 = [0, 1, 0, 1, 0, 1]
    geno = [(0, k, g) for k, g in enumerate(s0)] + [(1, k, g) for k, g in enumerate(s1)]
    e = spark.createDataFrame(expr, "gene BIGINT, sample BIGINT, v DOUBLE")
    g = spark.createDataFrame(geno, "snp BIGINT, sample BIGINT, g INT")
    return e, g


def test_f9_kruskal_wallis(spark):
    e, g = _kw_tables(spark, [0, 0, 1, 1, 2, 2])
    res = {(r["gene"], r["snp"]): r["stat"] for r in Q.kruskal_wallis(e, g, 2, 2, 6).collect()}
    assert abs(res[(0, 0)] - 1.142857) < 1e-6
    assert abs(res[(0, 1)] - 0.428571) < 1e-6
    assert abs(res[(1, 0)] - 2.0) < 1e-6
    assert abs(res[(1, 1)] - 0.761905) < 1e-6
    # Complete data: the complete-pair form gives the same statistics.
    res2 = {(r["gene"], r["snp"]): r["stat"] for r in Q.kruskal_wallis_missing(e, g, 2, 6).collect()}
    for k, v in res.items():
        assert abs(res2[k] - v) < 1e-9


def test_f10_missing_genotype(spark):
    e, g = _kw_tables(spark, [0, 0, None, 1, 2, 2])
    res = {(r["gene"], r["snp"]): r["stat"] for r in Q.kruskal_wallis_missing(e, g, 2, 6).collect()}
    assert abs(res[(0, 0)] - 2.4) < 1e-9


def test_f11_gnmf_step(spark):
    V = mat_from_dense(spark, [[1, 2, 3], [4, 5, 6]])
    W0 = mat_from_dense(spark, [[1, 2], [2, 1]])
    H0 = mat_from_dense(spark, [[1, 1, 2], [2, 1, 1]])
    W1, H1 = FZ.gnmf_step(V, W0, H0, 1e-8)
    np.testing.assert_allclose(dense(H1), [[0.692308, 1.333333, 2.142857], [0.857143, 1, 0.923077]], atol=1e-6)
    np.testing.assert_allclose(dense(W1), [[0.667708, 1.239523], [2.53293, 1.343463]], atol=1e-5)
    resid = A.frobenius(J.subtract(V, J.matmul(W1, H1))).first()[0]
    assert abs(resid - 1.481756) < 1e-5


def test_f12_edge_cases(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 1, 2.0), (1, 1, -2.0)], "i BIGINT, j BIGINT, v DOUBLE")
    m = S.from_entries(df, 2, 2)
    assert sorted(map(tuple, m.df.collect())) == [(0, 0, 3.0)]
    bad = spark.createDataFrame([(0, 5, 1.0)], "i BIGINT, j BIGINT, v DOUBLE")
    with pytest.raises(Exception):
        S.from_entries(bad, 2, 2).df.collect()
    a = mat_from_dense(spark, S1)
    np.testing.assert_allclose(dense(J.add(S.zeros(spark, 3, 3), a)), S1)
