"""What a task holds, and what an iteration shuffles, does not follow the table's size; results as before."""

import numpy as np
import pytest

from conftest import dense, mat_from_dense
from test_plans import plan_text


@pytest.fixture
def lines(spark, tmp_path):
    """A folder of tables: 50 suppliers and 80 parts, lines with repeated pairs and missing keys."""
    rng = np.random.default_rng(5)
    rows = [(int(s), int(p), float(q)) for s, p, q in zip(rng.integers(0, 50, 900), rng.integers(0, 80, 900), rng.integers(1, 9, 900))]
    rows += rows[:30] + [(7, 7, 1.0)] * 300 + [(None, 3, 2.0), (4, None, 5.0), (None, None, 1.0)]
    spark.createDataFrame(rows, "l_suppkey LONG, l_partkey LONG, l_quantity DOUBLE").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(80).selectExpr("id AS p_partkey", "id % 7 + 1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path), rows


def entries(df):
    return {(r["i"], r["j"]): r["v"] for r in df.collect()}


def test_edges_lie_in_bounded_partitions(spark, lines, monkeypatch):
    """distinct edges, degrees and the matrix's sums share partitions of a bounded number of rows; no join sorts the edges."""
    import tessera.core
    from tessera.plans import pagerank as PR
    from tessera.sources import tables as T

    folder, rows = lines
    monkeypatch.setattr(tessera.core, "ROWS_A_TASK", 50)
    e, n = T.edges(spark, folder)
    assert e.rdd.getNumPartitions() == -(-len(rows) // 50)
    P = PR.transition_matrix(e, n)
    plan = plan_text(P.df)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    distinct = {(s, p) for s, p, _ in rows}
    degree = {s: sum(a == s for a, _ in distinct) for s, _ in distinct}
    assert entries(P.df) == {(p, s): pytest.approx(1 / degree[s]) for s, p in distinct if s is not None}


def test_degrees_of_many_sources_are_joined_by_shuffle(spark):
    from tessera.operators.aggregates import out_degree_weights

    e = spark.createDataFrame([(k % 5, k) for k in range(40)] + [(None, 1), (2, None), (2, None)], "src LONG, dst LONG")
    few = sorted(map(str, out_degree_weights(e).collect()))
    spark.conf.set("tessera.broadcast.maxRows", "4")
    try:
        assert sorted(map(str, out_degree_weights(e).collect())) == few and len(few) == 42
    finally:
        spark.conf.unset("tessera.broadcast.maxRows")


def test_large_tables_of_entries_are_summed_in_bounded_partitions(spark, lines, monkeypatch):
    """Q's entries, whose pairs may repeat or miss a key, are summed where they are dealt."""
    import tessera.core
    from tessera.sources import tables as T

    folder, rows = lines
    monkeypatch.setattr(tessera.core, "ROWS_A_TASK", 50)
    q = T.q_matrix(spark, folder)
    assert q.df.rdd.getNumPartitions() == -(-len(rows) // 50)
    want = {}
    for s, p, v in rows:
        want[s, p] = want.get((s, p), 0) + v
    assert entries(q.df) == want


@pytest.fixture
def between(spark):
    """The shorter factor of a 6 x 40 matrix is broadcast, the longer one is not."""
    spark.conf.set("tessera.broadcast.maxRows", "20")
    yield
    spark.conf.unset("tessera.broadcast.maxRows")


@pytest.mark.usefixtures("between")
def test_factor_products_shuffle_only_the_shorter_side(spark):
    """sums of the longer side are complete where V's entries are, and those of the shorter side are all that is shuffled."""
    from tessera.plans.factorization import _InPlace, _wide

    v = np.arange(1, 241, dtype=float).reshape(6, 40)
    data = _InPlace(mat_from_dense(spark, v), 3, 4)
    w, h = np.arange(18, dtype=float).reshape(6, 3), np.arange(120, dtype=float).reshape(3, 40)
    wide_w = data.cut(_wide(mat_from_dense(spark, w).df, "i", "j", 3), "i")
    wide_h = data.cut(_wide(mat_from_dense(spark, h).df, "j", "i", 3), "j")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        by_column, by_row = data.sums(wide_w, "i", 3), data.sums(wide_h, "j", 3)
        assert "Exchange hashpartitioning" not in plan_text(by_column)
        assert plan_text(by_row).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = {r["x"]: r["s"] for r in by_column.collect()}
    np.testing.assert_allclose([got[k] for k in range(40)], v.T @ w)
    got = {r["x"]: r["s"] for r in by_row.collect()}
    np.testing.assert_allclose([got[k] for k in range(6)], v @ h.T)
    data.release()


@pytest.mark.usefixtures("between")
@pytest.mark.parametrize("turned", [False, True])
def test_gnmf_in_place_matches_numpy(spark, turned):
    """either side may be the longer one; entries that miss an index count nowhere, as before."""
    from tessera.core import Mat
    from tessera.plans import factorization as FZ

    rng = np.random.default_rng(9)
    v = rng.integers(1, 9, size=(40, 6) if turned else (6, 40)).astype(float)
    w = rng.integers(1, 4, size=(len(v), 3)).astype(float)
    h = rng.integers(1, 4, size=(3, v.shape[1])).astype(float)
    V = mat_from_dense(spark, v)
    odd = spark.createDataFrame([(None, 3, 5.0), (2, None, 7.0)], "i LONG, j LONG, v DOUBLE")
    V = Mat(V.df.unionByName(odd), V.nrows, V.ncols)
    Wm, Hm = FZ.gnmf(V, mat_from_dense(spark, w), mat_from_dense(spark, h), iterations=3)
    for _ in range(3):
        h = h * (w.T @ v) / ((w.T @ w) @ h + 1e-8)
        w = w * (v @ h.T) / (w @ (h @ h.T) + 1e-8)
    np.testing.assert_allclose(dense(Hm), h, rtol=1e-9)
    np.testing.assert_allclose(dense(Wm), w, rtol=1e-9)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tessera_")]


@pytest.mark.parametrize("way", ["counted", "shuffled", "dealt"])
def test_gemm_of_sides_too_large_by_shape(spark, monkeypatch, way):
    """a side of few counted entries is broadcast and the other one not sorted; a large product is dealt to places with C."""
    from tessera.core import Mat
    from tessera.operators import algebra as J

    rng = np.random.default_rng(4)
    a, b, c = ((rng.random(s) < p) * rng.integers(1, 5, s).astype(float) for s, p in (((30, 20), 0.9), ((20, 12), 0.1), ((30, 12), 0.3)))
    a[:, 4], b[4] = 1, 2  # an inner index that all rows and columns share
    x, y, z = (mat_from_dense(spark, m) for m in (a, b, c))
    odd = spark.createDataFrame([(None, 4, 5.0), (2, None, 7.0)], "i LONG, j LONG, v DOUBLE")
    x = Mat(x.df.unionByName(odd), x.nrows, x.ncols)  # the row without an index stays, the entry without an inner index meets none
    monkeypatch.setattr(J, "PRODUCTS_A_TASK", 100 if way == "dealt" else 1 << 26)
    spark.conf.set("tessera.broadcast.maxRows", "100" if way == "counted" else "0")
    try:
        got = J.gemm(2.0, x, y, 0.5, z)
        plan = plan_text(got.df)
        assert {"counted": "BroadcastHashJoin", "shuffled": "SortMergeJoin", "dealt": "MapInArrow"}[way] in plan
        assert ("SortMergeJoin" in plan) == (way == "shuffled")
        found = entries(got.df)
    finally:
        spark.conf.unset("tessera.broadcast.maxRows")
    want = 2 * a @ b + 0.5 * c
    expected = {(int(i), int(j)): want[i, j] for i, j in zip(*np.nonzero(want))} | {(None, j): 20.0 for j in range(12)}
    assert found == {k: pytest.approx(v) for k, v in expected.items()}
