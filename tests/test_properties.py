"""Algebraic properties on random small matrices, and every plan strategy
(broadcast, skew-split shuffle with hot keys) against numpy."""

import numpy as np
import pytest

from conftest import dense, dense_vec, mat_from_dense, vec_from_dense
from tessera.operators import aggregates as A
from tessera.operators import algebra as J
from tessera.operators import elementwise as E
from tessera.operators import ranking as W
from tessera.operators import reshape as X
from tessera.sources import entries as S

RNG = np.random.default_rng(5)


def rand_sparse(m, n, density=0.4, hot_col=None):
    a = RNG.integers(1, 9, size=(m, n)).astype(float) * (RNG.random((m, n)) < density)
    if hot_col is not None:
        a[:, hot_col] = RNG.integers(1, 9, size=m)
    return a


@pytest.fixture()
def skewed(spark):
    """Force the skew machinery: nothing broadcast, any key over 3 rows is hot."""
    spark.conf.set("tessera.broadcast.maxRows", "0")
    spark.conf.set("tessera.skew.hotKeyRows", "3")
    yield
    spark.conf.unset("tessera.broadcast.maxRows")
    spark.conf.unset("tessera.skew.hotKeyRows")


def test_transpose_involution_and_product_transpose(spark):
    a, b = rand_sparse(7, 5), rand_sparse(5, 6)
    ma, mb = mat_from_dense(spark, a), mat_from_dense(spark, b)
    np.testing.assert_allclose(dense(E.transpose(E.transpose(ma))), a)
    np.testing.assert_allclose(dense(E.transpose(J.matmul(ma, mb))), dense(J.matmul(mb.T, ma.T)))


def test_associativity_and_chains(spark):
    from tessera.plans import chains as C

    a, b, c, d = rand_sparse(4, 6), rand_sparse(6, 5), rand_sparse(5, 7), rand_sparse(7, 3)
    mats = [mat_from_dense(spark, x) for x in (a, b, c, d)]
    expect = a @ b @ c @ d
    for bracket in ["((AB)C)D", "(AB)(CD)", "A(B(CD))", "(A(BC))D", "A((BC)D)"]:
        np.testing.assert_allclose(dense(C.chain_multiply(mats, bracket)), expect)
    m, order = C.chain_cost_ordered(mats, block=2, ratio=0.5, product_ratio=0.5)
    np.testing.assert_allclose(dense(m), expect)
    assert sorted(order.replace("(", "").replace(")", "")) == list("ABCD")


def test_identities(spark):
    a = rand_sparse(6, 6)
    ma = mat_from_dense(spark, a)
    np.testing.assert_allclose(dense(J.add(ma, S.zeros(spark, 6, 6))), a)
    np.testing.assert_allclose(dense(J.matmul(ma, S.eye(spark, 6))), a)
    fro = A.frobenius(ma).first()[0]
    np.testing.assert_allclose(fro ** 2, np.trace(a @ a.T))
    np.testing.assert_allclose(dense(J.subtract(ma, ma)), np.zeros((6, 6)))
    assert J.subtract(ma, ma).df.count() == 0


@pytest.mark.usefixtures("skewed")
def test_matmul_strategies_agree_under_skew(spark):
    a, b = rand_sparse(12, 8, hot_col=3), rand_sparse(8, 10)
    b[3, :] = RNG.integers(1, 9, size=10)  # key 3 hot on both sides
    ma, mb = mat_from_dense(spark, a), mat_from_dense(spark, b)
    np.testing.assert_allclose(dense(J.matmul(ma, mb, strategy="shuffle")), a @ b)
    np.testing.assert_allclose(dense(J.matmul(ma, mb)), a @ b)
    x = RNG.integers(1, 5, size=8).astype(float)
    np.testing.assert_allclose(dense_vec(J.matvec(ma, vec_from_dense(spark, x))), a @ x)
    y = RNG.integers(1, 5, size=12).astype(float)
    np.testing.assert_allclose(dense_vec(J.vecmat(vec_from_dense(spark, y), ma)), y @ a)
    np.testing.assert_allclose(dense(E.row_normalize(ma)), a / np.abs(a).sum(axis=1, keepdims=True))
    z = vec_from_dense(spark, x)
    np.testing.assert_allclose(dense(J.outer_product(z, vec_from_dense(spark, y))), np.outer(x, y))


@pytest.mark.usefixtures("skewed")
def test_ranks_split_hot_groups(spark):
    # One row holds most entries and many ties; it is cut into buckets.
    vals = [(0, j, float(RNG.integers(0, 6))) for j in range(60)] + [(1, j, float(j % 4)) for j in range(5)]
    vals += [(0, 60, None), (0, 61, None), (1, 5, None)]
    t = spark.createDataFrame(vals, "i BIGINT, j BIGINT, v DOUBLE")
    got = {(r["i"], r["j"]): r["rank"] for r in W.rank_rows_average(t).collect()}
    import pandas as pd

    pdf = pd.DataFrame(vals, columns=["i", "j", "v"])
    for i, g in pdf.groupby("i"):
        present = g[g.v.notna()]
        ranks = present.v.rank(method="average")
        for j, r in zip(present.j, ranks):
            assert got[(i, j)] == r
        missing = g[g.v.isna()].sort_values("j")
        for k, j in enumerate(missing.j):
            assert got[(i, j)] == len(present) + k + 1
    gmin = {(r["i"], r["j"]): r["rank"] for r in W.rank_rows_min(t).collect()}
    for i, g in pdf[pdf.v.notna()].groupby("i"):
        for j, r in zip(g.j, g.v.rank(method="min")):
            assert gmin[(i, j)] == r


@pytest.mark.usefixtures("skewed")
def test_prefix_sum_global_split(spark):
    from tessera.plans.skew import prefix_sum

    df = spark.createDataFrame([(k, k % 5 + 1) for k in range(50)], "idx BIGINT, w BIGINT")
    out = {r["idx"]: r["c"] for r in prefix_sum(df, [], "idx", "w", "c").collect()}
    run = np.cumsum([k % 5 + 1 for k in range(50)])
    assert [out[k] for k in range(50)] == list(run)


def test_layouts_keep_entries(spark):
    a = rand_sparse(7, 9)
    ma = mat_from_dense(spark, a)
    for m in [X.range_partition(ma, 3), X.partition_by_row(ma, 3), X.partition_by_column(ma, 3), X.repartition(ma, 2), X.persist(ma)]:
        np.testing.assert_allclose(dense(m), a)
    np.testing.assert_allclose(dense(X.densify(ma)), a)
    assert X.densify(ma).df.count() == 63
    np.testing.assert_allclose(dense(X.hconcat([ma, ma])), np.hstack([a, a]))
    np.testing.assert_allclose(dense(X.vconcat([ma, ma])), np.vstack([a, a]))


def test_generators(spark):
    r = S.rand_matrix(spark, 5, 4, 2.0, 3.0, seed=3)
    d = dense(r)
    assert d.shape == (5, 4) and (d >= 2.0).all() and (d < 3.0).all()
    sp = S.sprand(spark, 10, 10, 0.13, seed=4)
    assert sp.df.count() == 13 and sp.df.select("i", "j").distinct().count() == 13
    sk = S.skewed_sparse(spark, 20, 10, 0.2, 0.5, by="row")
    assert sk.df.count() == 40
    counts = sorted((r["count"] for r in sk.df.groupBy("i").count().collect()), reverse=True)
    assert counts[0] == 10 and counts[1] == 10  # skewed: first rows fill up
    np.testing.assert_allclose(dense(S.eye(spark, 3)), np.eye(3))
    np.testing.assert_allclose(dense(S.diag(vec_from_dense(spark, [1, 0, 3]))), np.diag([1, 0, 3]))
    np.testing.assert_allclose(dense(S.from_column_major(spark, 2, 3, [1, 2, 3, 4, 5, 6])), [[1, 3, 5], [2, 4, 6]])
    assert dense(S.ones(spark, 2, 3)).sum() == 6


def test_sinks_roundtrip(spark, tmp_path):
    from tessera.operators import sinks as K

    a = rand_sparse(5, 4)
    ma = mat_from_dense(spark, a)
    K.save(ma, str(tmp_path / "m"))
    back = K.load(spark, str(tmp_path / "m"))
    assert back.shape == (5, 4)
    np.testing.assert_allclose(dense(back), a)
    rep = K.validate(ma).first()
    assert rep["duplicate_keys"] == 0 and rep["out_of_shape"] == 0 and rep["zeros"] == 0
    st = A.stat(ma, 2, 2).first()
    assert st["nnz"] == int((a != 0).sum())
    blocks = {(i // 2, j // 2) for i, j in zip(*np.nonzero(a))}
    assert st["stored_blocks"] == len(blocks) and (st["row_blocks"], st["col_blocks"]) == (3, 2)


def test_display_and_local_guard(spark, capsys):
    from tessera.operators import sinks as K

    ma = mat_from_dense(spark, np.array([[0.0, 2.0], [3.0, 0.0]]))
    K.display(ma)
    out = capsys.readouterr().out
    assert "2.0" in out and "3.0" in out
    spark.conf.set("tessera.dense.maxCells", "3")
    try:
        with pytest.raises(ValueError):
            K.to_local(ma)
    finally:
        spark.conf.unset("tessera.dense.maxCells")


def test_skew_schedule_matches_sequential_rule():
    from tessera.sources.entries import skew_schedule

    def brute(lines, width, total, skew):
        r, out = total, []
        for _ in range(lines):
            if r <= 0:
                break
            c = min(max(min(int(r * skew), width), 1), r)
            out.append(c)
            r -= c
        return out

    rng = np.random.default_rng(3)
    for _ in range(500):
        lines, width = int(rng.integers(1, 200)), int(rng.integers(1, 200))
        total = int(rng.integers(0, lines * width + 1))
        skew = float(rng.choice([0.0, 1e-6, 0.01, 0.25, 0.5, 1.0, 2.0, rng.random()]))
        if sum(brute(lines, width, total, skew)) < total:
            with pytest.raises(ValueError):
                skew_schedule(lines, width, total, skew)
            continue
        got = [c for lo, hi, c in skew_schedule(lines, width, total, skew) for _ in range(hi - lo)]
        assert got == brute(lines, width, total, skew)


def test_hash_generators_are_layout_independent(spark):
    from tessera.sources import entries as S2

    a = S2.rand_matrix(spark, 30, 7, seed=4).df
    b = S2.rand_matrix(spark, 30, 7, seed=4).df.repartition(5)
    assert sorted(a.collect()) == sorted(b.collect())
    sp = S2.sprand(spark, 40, 40, 0.2, seed=2, normal=True)
    rows = sp.df.collect()
    assert len(rows) == 320 and len({(r.i, r.j) for r in rows}) == 320


def test_gram_symmetric_product(spark):
    a = rand_sparse(9, 6)
    ma = mat_from_dense(spark, a)
    np.testing.assert_allclose(dense(J.gram(ma)), a @ a.T)


@pytest.mark.usefixtures("skewed")
def test_gram_under_skew(spark):
    a = rand_sparse(9, 6, hot_col=2)
    np.testing.assert_allclose(dense(J.gram(mat_from_dense(spark, a))), a @ a.T)


def test_global_prefix_sum_is_split(spark):
    from tessera.plans.skew import prefix_sum

    spark.conf.set("tessera.skew.hotKeyRows", "5")
    try:
        df = spark.range(200).selectExpr("id AS k", "(id % 7) AS w")
        out = {r["k"]: r["c"] for r in prefix_sum(df, [], "k", "w", "c").collect()}
        w = np.arange(200) % 7
        assert [out[k] for k in range(200)] == list(np.cumsum(w))
        p = prefix_sum(df, [], "k", "w", "c")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in p
    finally:
        spark.conf.unset("tessera.skew.hotKeyRows")


def test_row_layout_segments_are_bounded_and_round_trip(spark):
    a = rand_sparse(5, 9, density=0.9, hot_col=4)
    ma = mat_from_dense(spark, a)
    rows = S.to_rows(ma, segment=3)
    recs = rows.collect()
    assert all(len(r["vec"]) <= 3 for r in recs)
    for r in recs:
        js = [e["j"] for e in r["vec"]]
        assert js == sorted(js) and all(j // 3 == r["seg"] for j in js)
    np.testing.assert_allclose(dense(S.from_rows(rows, 5, 9)), a)
    cols = S.to_columns(ma, segment=2).collect()
    assert all(len(r["vec"]) <= 2 for r in cols)


@pytest.mark.usefixtures("skewed")
def test_gnmf_prepared_path_matches_numpy(spark):
    from tessera.plans import factorization as FZ

    v = RNG.integers(1, 9, size=(7, 5)).astype(float)
    w = RNG.integers(1, 4, size=(7, 2)).astype(float)
    h = RNG.integers(1, 4, size=(2, 5)).astype(float)
    Wm, Hm = FZ.gnmf(mat_from_dense(spark, v), mat_from_dense(spark, w), mat_from_dense(spark, h), iterations=3)
    for _ in range(3):
        h = h * (w.T @ v) / ((w.T @ w) @ h + 1e-8)
        w = w * (v @ h.T) / (w @ (h @ h.T) + 1e-8)
    np.testing.assert_allclose(dense(Hm), h, rtol=1e-9)
    np.testing.assert_allclose(dense(Wm), w, rtol=1e-9)


def test_ranks_mixed_hot_and_cold_groups(spark):
    """Group 0 is hot (bucketed path), group 1 is not (window path)."""
    import pandas as pd

    from tessera.plans.skew import ranks

    vals = [(0, j, float(j % 9)) for j in range(80)] + [(1, j, float(j % 3)) for j in range(7)]
    vals += [(0, 80, None), (1, 7, None), (1, 8, None)]
    t = spark.createDataFrame(vals, "g BIGINT, s BIGINT, v DOUBLE")
    spark.conf.set("tessera.skew.hotKeyRows", "20")
    try:
        got = {(r["g"], r["s"]): (r["rank_min"], r["rank_avg"]) for r in ranks(t, ["g"], "v", "s").collect()}
    finally:
        spark.conf.unset("tessera.skew.hotKeyRows")
    pdf = pd.DataFrame(vals, columns=["g", "s", "v"])
    for g, grp in pdf.groupby("g"):
        present = grp[grp.v.notna()]
        for s_, mn, av in zip(present.s, present.v.rank(method="min"), present.v.rank(method="average")):
            assert got[(g, s_)] == (mn, av)
        for k, s_ in enumerate(grp[grp.v.isna()].sort_values("s").s):
            assert got[(g, s_)] == (len(present) + k + 1,) * 2
