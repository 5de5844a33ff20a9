"""Products dealt to blocks of the result against dense ones."""

import numpy as np
import pytest

from conftest import dense, mat_from_dense, vec_from_dense
from tessera.operators import algebra as J
from tessera.plans import blocks
from tessera.plans.factorization import bfgs_step


def sparse(rng, shape, share=0.3):
    return (rng.random(shape) < share) * rng.integers(-4, 5, shape).astype(float)


@pytest.fixture
def packed(monkeypatch):
    """Every product is dealt, in many sends and slabs."""
    monkeypatch.setattr(J, "PRODUCTS_A_TASK", 40)
    monkeypatch.setattr(J, "UPDATE_CELLS", 40)
    monkeypatch.setattr(J, "PLACE_ENTRIES", 60)


@pytest.fixture
def conf(spark):
    """Settings that are unset again."""
    held = []

    def put(**settings):
        for k, v in settings.items():
            spark.conf.set(k, str(v))
            held.append(k)

    yield put
    for k in held:
        spark.conf.unset(k)


@pytest.mark.parametrize("slab, sent", [(8, 5), (64, 9), (1 << 22, 1 << 17)])
def test_slabs_form_every_cell(slab, sent, monkeypatch):
    monkeypatch.setattr(blocks, "SLAB_CELLS", slab)
    monkeypatch.setattr(blocks, "SENT_ROWS", sent)
    rng = np.random.default_rng(slab)
    a, b, c = sparse(rng, (23, 17)), sparse(rng, (17, 19)), sparse(rng, (23, 19), 0.1)
    a[3] = b[:, 4] = 2.0
    parts = {}
    for side, m in enumerate((a, b.T, c)):
        x, k = np.nonzero(m)
        halves = np.array_split(rng.permutation(len(x)), 2)
        parts[side] = [(x[h], k[h], m[x[h], k[h]]) for h in halves]
    got, cells = np.zeros((23, 19)), 0
    for i, j, v in blocks._Place(parts).slabs():
        got[i, j] += v
        cells += len(v)
    np.testing.assert_allclose(got, a @ b + c)
    assert cells == np.count_nonzero(a @ b + c)


@pytest.mark.parametrize("terms", [0, 1 << 20])
def test_slabs_of_few_inner_indices_are_dense_products(terms, monkeypatch):
    monkeypatch.setattr(blocks, "SLAB_CELLS", 64)
    monkeypatch.setattr(blocks, "DENSE_TERMS", terms)
    rng = np.random.default_rng(21)
    a, b, c = sparse(rng, (23, 5)), sparse(rng, (5, 19)), sparse(rng, (23, 19), 0.1)
    for infinite in (False, True):
        if infinite:
            a[4, 2], b[2, 3], b[3, 3], a[4, 3] = np.inf, 1.0, np.inf, -1.0  # inf - inf: no cell
        parts = {side: [(*np.nonzero(m), m[np.nonzero(m)])] for side, m in enumerate((a, b.T, c))}
        with np.errstate(all="ignore"):
            want = np.array([[np.sum((a[i] * b[:, j])[(a[i] != 0) & (b[:, j] != 0)]) + c[i, j] for j in range(19)] for i in range(23)])
        want[np.isnan(want)] = 0
        got = np.zeros((23, 19))
        for i, j, v in blocks._Place(dict(parts)).slabs():
            got[i, j] += v
        np.testing.assert_allclose(got, want)
        assert blocks._Place(dict(parts)).count_cells() == np.count_nonzero(want)


def test_large_products_are_dealt(spark, packed):
    rng = np.random.default_rng(5)
    a, b = sparse(rng, (31, 20)), sparse(rng, (20, 27))
    x, y = mat_from_dense(spark, a), mat_from_dense(spark, b)
    cost = J.product_counts(x, y)
    assert cost.deals_packed and np.prod(cost.places) > 4
    np.testing.assert_allclose(dense(J.matmul(x, y, strategy="stationary")), a @ b)
    np.testing.assert_allclose(dense(J.matmul_outer(x, y)), a @ b)
    plan = J.packed_product(x, y, cost)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_dealt_product_keeps_null_rows(spark):
    left = spark.createDataFrame([(None, 0, 2.0), (1, 0, 3.0), (1, None, 5.0), (1, 1, None)], "i LONG, k LONG, v DOUBLE")
    right = spark.createDataFrame([(0, 7, 1.0), (0, None, 4.0), (None, 7, 9.0), (1, 7, 1.0)], "k LONG, j LONG, v DOUBLE")
    added = spark.createDataFrame([(1, 7, -3.0), (None, None, 1.0), (4, 4, 0.5)], "i LONG, j LONG, v DOUBLE")
    got = {(r.i, r.j): r.v for r in blocks.dealt_product(left, right, (2, 3), added).collect()}
    assert got == {(None, 7): 2.0, (None, None): 9.0, (1, None): 12.0, (4, 4): 0.5}
    assert blocks.dealt_product(left.filter("false"), right, (2, 2)).collect() == []


def test_large_updates_are_dealt(spark, packed):
    rng = np.random.default_rng(6)
    a, x = sparse(rng, (15, 15)), rng.integers(-2, 3, 15).astype(float)
    np.testing.assert_allclose(dense(J.rank_one_update(mat_from_dense(spark, a), vec_from_dense(spark, x), 0.5)), a + 0.5 * np.outer(x, x))
    g1, g2 = rng.integers(-2, 3, (2, 15)).astype(float)
    s, y = -g1, g2 - g1
    got = dense(bfgs_step(mat_from_dense(spark, a), vec_from_dense(spark, g1), vec_from_dense(spark, g2)))
    np.testing.assert_allclose(got, a + np.outer(y, y) - np.outer(a @ s, s @ a))


def test_updates_of_a_dealt_product_are_added_where_it_is_formed(spark, packed, monkeypatch):
    rng = np.random.default_rng(16)
    a, x, y = sparse(rng, (15, 20)), *rng.integers(-2, 3, (2, 15)).astype(float)
    m = mat_from_dense(spark, a)
    product = J.matmul(m, m.T, strategy="stationary")
    monkeypatch.setattr(J, "cut_lineage", lambda df: pytest.fail("the product is written"))
    got = J.low_rank_update(product, [(0.5, vec_from_dense(spark, x), vec_from_dense(spark, y)), (1.0, vec_from_dense(spark, x), vec_from_dense(spark, x))])
    np.testing.assert_allclose(dense(got), a @ a.T + 0.5 * np.outer(x, y) + np.outer(x, x))
    # A cell whose terms are no number is not stored, so it takes the update alone; an infinite value meets stored ones only.
    odd = a.copy()
    odd[2, 3], odd[2, 4], odd[5, 3], odd[5, 4] = np.inf, -np.inf, 1.0, 1.0
    x[2], x[5], x[7], x[8] = 2.0, 3.0, np.inf, 0.0
    m, v = mat_from_dense(spark, odd), vec_from_dense(spark, x)
    with np.errstate(all="ignore"):
        terms = [[odd[i] * odd[j] for j in range(15)] for i in range(15)]
        stored = np.array([[np.sum(t[(odd[i] != 0) & (odd[j] != 0)]) for j, t in enumerate(r)] for i, r in enumerate(terms)])
        want = np.where(np.isnan(stored), 0, stored) + np.where(np.outer(x != 0, x != 0), np.outer(x, x), 0)
    cells = {(r.i, r.j): r.v for r in J.rank_one_update(J.matmul(m, m.T, strategy="stationary"), v).df.collect()}
    assert cells == {(i, j): want[i, j] for i in range(15) for j in range(15) if want[i, j] != 0 and not np.isnan(want[i, j])}


@pytest.mark.parametrize("grid", [(2, 3), (6, 5)])
def test_dealt_product_shuffles_each_entry_once(spark, grid):
    """Places read their blocks from where these lie: what is shuffled does not follow their number."""
    rng = np.random.default_rng(17)
    a, b = sparse(rng, (40, 30)), sparse(rng, (30, 50))
    left = mat_from_dense(spark, a).df.selectExpr("i", "j k", "v")
    right = mat_from_dense(spark, b).df.selectExpr("i k", "j", "v")
    out = blocks.dealt_product(left, right, grid)
    assert {(r.i, r.j): r.v for r in out.collect()} == {(i, j): v for (i, j), v in np.ndenumerate(a @ b) if v}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert out.rdd.getNumPartitions() == grid[0] * grid[1]


def test_cells_of_a_dealt_product_are_counted_in_their_places(spark, packed):
    rng = np.random.default_rng(18)
    a, b = sparse(rng, (31, 20)), sparse(rng, (20, 27))
    m = J.matmul(mat_from_dense(spark, a), mat_from_dense(spark, b), strategy="stationary")
    got = J.stored_cells(m)
    assert [tuple(r) for r in got.collect()] == [(np.count_nonzero(a @ b),)] == [(m.df.count(),)] and got.columns == ["nnz"]
    assert "n#" in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1].split("]")[0]
    assert J.stored_cells(mat_from_dense(spark, a)).first().nnz == np.count_nonzero(a)
    none = J.matmul(J.Mat(m.df.filter("false"), 31, 27), mat_from_dense(spark, b.T), strategy="stationary")
    assert J.stored_cells(none).first().nnz == 0


def test_updates_of_a_full_matrix_stay_in_place(spark, packed):
    rng = np.random.default_rng(7)
    a = rng.integers(1, 5, (15, 15)).astype(float)
    x, y = (rng.integers(-2, 3, (2, 15)).astype(float))
    m, vx, vy = mat_from_dense(spark, a), vec_from_dense(spark, x), vec_from_dense(spark, y)
    got = J.low_rank_update(m, [(0.5, vx, vy), (-1.0, vy, vx)])
    np.testing.assert_allclose(dense(got), a + 0.5 * np.outer(x, y) - np.outer(y, x))
    assert "MapInArrow" not in got.df._jdf.queryExecution().executedPlan().toString()
    # A cell that A lacks, or a NULL index, is left to the outer products.
    for other in (vec_from_dense(spark, x), vy):
        hole = m.df.filter("i != 3 or j != 4")
        kept = J.low_rank_update(J.Mat(hole, 15, 15), [(1.0, other, vy)])
        assert "MapInArrow" in kept.df._jdf.queryExecution().executedPlan().toString()
    null = J.Vec(vx.df.unionByName(spark.createDataFrame([(None, 2.0)], "i LONG, v DOUBLE")), 15)
    cells = J.low_rank_update(m, [(1.0, null, vy)]).df
    assert cells.filter("i is null").count() == np.count_nonzero(y)


def test_skewed_lines_dealt_to_partitions(spark):
    from tessera.core import joins_in_place
    from tessera.sources.entries import skewed_sparse

    plain, dealt = (skewed_sparse(spark, 12, 9, 0.4, 0.5, chunk=4, parts=parts) for parts in (None, 5))
    assert sorted(plain.df.collect()) == sorted(dealt.df.collect())
    q = spark.range(12).selectExpr("id i", "id % 9 j", "1.0 q").repartition(5, "i").hint("shuffle_hash")
    with joins_in_place(spark):
        plan = dealt.df.join(q, ["i", "j"])._jdf.queryExecution().executedPlan().toString()
    # Lines are shuffled before they are expanded, and Q's entries; nothing is sorted.
    assert plan.count("Exchange") == 2 and "ShuffledHashJoin" in plan and "Sort " not in plan


def test_large_gram_is_dealt_to_half_the_places(spark, packed):
    rng = np.random.default_rng(8)
    a = sparse(rng, (31, 20))
    m = mat_from_dense(spark, a)
    got = J.gram(m)
    np.testing.assert_allclose(dense(got), a @ a.T)
    assert got.df.select("i", "j").distinct().count() == got.df.count()
    assert "Join" not in got.df._jdf.queryExecution().executedPlan().toString()
    null = J.Mat(m.df.unionByName(spark.createDataFrame([(None, 1, 2.0)], "i LONG, j LONG, v DOUBLE")), 31, 20)
    assert sorted(J.gram(null).df.collect()) == sorted(got.df.collect())


def test_large_shuffled_and_salted_products_are_dealt(spark, conf, packed):
    rng = np.random.default_rng(9)
    a, b = sparse(rng, (31, 20)), sparse(rng, (20, 27))
    x, y = mat_from_dense(spark, a), mat_from_dense(spark, b)
    conf(**{"tessera.skew.hotKeyRows": 2, "tessera.broadcast.maxRows": 0})
    for got in (J.matmul(x, y, strategy="shuffle"), J.matmul(x, y)):
        np.testing.assert_allclose(dense(got), a @ b)
        assert "Join" not in got.df._jdf.queryExecution().executedPlan().toString()


def test_a_small_side_with_a_large_product_is_dealt(spark, conf, packed):
    rng = np.random.default_rng(10)
    a, b = sparse(rng, (31, 4)), sparse(rng, (4, 27), 0.8)
    x, y = mat_from_dense(spark, a), mat_from_dense(spark, b)
    conf(**{"tessera.broadcast.maxRows": 125})
    got = J.matmul(J.matmul(x, y), mat_from_dense(spark, b.T))
    np.testing.assert_allclose(dense(got), a @ b @ b.T)
    assert "MapInArrow" in J.matmul(x, y).df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_minima_of_the_columns_reached(spark):
    import math

    from tessera.plans import chains as C

    m = mat_from_dense(spark, np.array([[1.0, 0, 2, 0], [0, 0, 0, 0], [0, 3, 4, 5]]))
    shares = spark.range(4).withColumnRenamed("id", "j").select("j", *[C._column_share(t) for t in range(5)]).collect()
    ranks = {r[0]: [-math.log(x) for x in r[1:]] for r in shares}
    got = {r.k: r.f for r in C._row_ranks(m, None, 5).collect()}
    want = {i: [min(ranks[j][t] for j in js) for t in range(5)] for i, js in ((0, (0, 2)), (2, (1, 2, 3)))}
    assert got.keys() == want.keys()
    for i in want:
        np.testing.assert_allclose(got[i], want[i])


@pytest.mark.parametrize("bracket", ["(AB)(CD)", "A(B(CD))", "A((BC)D)"])
def test_a_product_of_a_dealt_product_is_formed_in_its_places(spark, conf, packed, monkeypatch, bracket):
    from tessera.plans.chains import chain_multiply

    monkeypatch.setattr(blocks, "SLAB_CELLS", 50)
    monkeypatch.setattr(blocks, "CHAIN_WIDTH", 7)
    monkeypatch.setattr(J, "PLACE_ENTRIES", 400)
    rng = np.random.default_rng(11)
    mats = [sparse(rng, shape, share) for shape, share in (((3, 12), 0.4), ((12, 30), 0.3), ((30, 6), 0.3), ((6, 30), 0.3))]
    conf(**{"tessera.broadcast.maxRows": 40})
    got = chain_multiply([mat_from_dense(spark, m) for m in mats], bracket)
    np.testing.assert_allclose(dense(got), np.linalg.multi_dot(mats))
    assert got.factors is not None and len(got.factors.mats) == (4 if bracket == "A(B(CD))" else 3)
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]


@pytest.mark.parametrize("grid", [(1, 3), (2, 2)])
def test_dealt_chain_keeps_null_rows_and_infinite_values(spark, grid):
    def table(rows):
        return spark.createDataFrame(rows, "i LONG, j LONG, v DOUBLE")

    inf, nan = float("inf"), float("nan")
    first = table([(None, 0, 2.0), (1, 0, 3.0), (1, None, 5.0), (2, 1, inf), (3, 2, 1.0), (3, 0, 1.0), (2, 9, 4.0)])
    left = table([(0, 0, 1.0), (1, 1, 1.0), (None, 0, 7.0), (2, None, 7.0), (2, 2, inf), (2, 3, -inf)])
    right = table([(0, 7, 1.0), (0, None, 4.0), (None, 7, 9.0), (1, 8, 2.0), (2, 7, 1.0), (3, 7, 1.0), (2, 8, 0.5)])
    got = {(r.i, r.j): r.v for r in blocks.dealt_chain([first, left, right], grid).collect()}
    # Cell (2, 7) of the inner product is inf - inf and no cell.
    assert got == {(None, 7): 2.0, (None, None): 8.0, (1, 7): 3.0, (1, None): 12.0, (2, 8): inf, (3, 8): inf, (3, 7): 1.0, (3, None): 4.0}
    assert blocks.dealt_chain([first, left.filter("false"), right], grid).collect() == []
    bad = {(r.i, r.j) for r in blocks.dealt_chain([table([(0, 0, inf), (0, 1, -inf)]), table([(0, 0, 1.0), (1, 0, 1.0)]), right], grid).collect()}
    assert bad == set()


def test_random_cells_dealt_by_column_are_the_same(spark):
    from tessera.sources import entries as S

    for shape, density in (((12, 9), 0.4), ((1, 50), 0.3), ((97, 41), 0.125)):
        for normal in (False, True):
            plain, dealt = (S.sprand(spark, *shape, density, 9, normal, parts) for parts in (None, 5))
            assert sorted(plain.df.collect()) == sorted(dealt.df.collect())
    for make in (S.rand_matrix, S.randn_matrix):
        assert sorted(make(spark, 12, 9).df.collect()) == sorted(make(spark, 12, 9, parts=5).df.collect())
    assert S.randn_matrix(spark, 0, 5, parts=3).df.count() == 0


def test_generated_cells_are_not_shuffled(spark):
    """Only columns and Q's entries are; every generated cell is added to, or counted, where it is drawn."""
    from tessera.core import joins_in_place
    from tessera.sources.entries import randn_matrix, sprand

    rng = np.random.default_rng(12)
    a = sparse(rng, (12, 9))
    m = mat_from_dense(spark, a)
    null = spark.createDataFrame([(None, 4, 2.0), (3, None, 1.5)], "i LONG, j LONG, v DOUBLE")
    q = J.Mat(m.df.unionByName(null).repartition(5, "j"), 12, 9)
    noise = randn_matrix(spark, 12, 9, seed=5, parts=5)
    with joins_in_place(spark):
        got = J.add(q, noise, every_cell=True)
        plan = got.df._jdf.queryExecution().executedPlan().toString()
        cells = sorted(((r.i is None, r.j is None, r.i, r.j), round(r.v, 9)) for r in got.df.collect())
    want = sorted(((r.i is None, r.j is None, r.i, r.j), round(r.v, 9)) for r in J.add(q, noise).df.collect())
    assert cells == want and len(cells) == 110
    assert "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning(j") == plan.count("Exchange hashpartitioning(j#") and "ENSURE_REQUIREMENTS" not in plan.split("LeftOuter")[0]
    mask = sprand(spark, 12, 9, 0.4, seed=9, parts=5)
    counted = mask.df.select("i", "j").unionByName(q.df.select("i", "j")).groupBy("i", "j").count()
    assert "ENSURE_REQUIREMENTS" not in counted._jdf.queryExecution().executedPlan().toString().split("Union")[0]


@pytest.mark.parametrize("axis", ["row", "col"])
def test_many_stored_blocks_share_folders(spark, tmp_path, monkeypatch, axis):
    from tessera.operators import aggregates as A
    from tessera.operators import sinks as K

    monkeypatch.setattr(K, "MOST_FOLDERS", 3)
    a = sparse(np.random.default_rng(13), (40, 30), 0.5)
    m = mat_from_dense(spark, a)
    K.save_blocks(m, str(tmp_path / "m"), 5, axis)
    assert len(list((tmp_path / "m").glob("blk=*"))) <= 3
    stored = K.load_blocks(spark, str(tmp_path / "m"))
    np.testing.assert_allclose(dense(stored.matrix()), a)
    for block, ratio in ((5, 0.4), (10, 0.5), (5, 0.01), (20, 1.0)):
        got = sorted(map(tuple, stored.block_nnz_sample(block, ratio).collect()))
        assert got == sorted(map(tuple, A.block_nnz_sample(m, block, ratio, axis).collect()))
    cells = [(3, 7), (4, 9), (39, 29)]
    assert {(r["i"], r["j"]): r["v"] for r in stored.lookup(cells).collect()} == {c: a[c] for c in cells}
