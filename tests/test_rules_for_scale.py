"""Cases that the registered rows do not reach: hot and NULL groups, many hot keys, bad input, large indices."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from conftest import dense, mat_from_dense, vec_from_dense
from tessera.core import Vec
from tessera.operators import aggregates as A
from tessera.operators import algebra as J
from tessera.operators import elementwise as E
from tessera.operators import ranking as W
from tessera.operators import reshape as X
from tessera.operators import sinks as K
from tessera.plans import eqtl as Q
from tessera.plans import factorization as FZ
from tessera.plans.skew import join_prepared, prefix_sum, prepare_repeated_join, ranks, salted_join
from tessera.sources import entries as S
from tessera.sources import text as TX


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    names = []

    def put(**values):
        for k, v in values.items():
            name = {"hot": "tessera.skew.hotKeyRows", "keys": "tessera.skew.maxHotKeys", "rows": "tessera.broadcast.maxRows"}[k]
            names.append(name)
            spark.conf.set(name, str(v))

    yield put
    for name in names:
        spark.conf.unset(name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


GROUPS = [None] * 40 + [1] * 30 + [2] * 7 + [3] * 55 + [None] * 3


@pytest.mark.parametrize("hot, keys", [(1000, 100), (20, 100), (20, 1), (5, 2)])
def test_prefix_sum_keeps_every_group(spark, conf, hot, keys):
    conf(hot=hot, keys=keys)
    rows = [(g, k, (k * 7) % 5) for k, g in enumerate(GROUPS)]
    df = spark.createDataFrame(rows, "g LONG, k LONG, w LONG").repartition(3)
    want, run = {}, {}
    for g, k, w in rows:
        want[g, k] = run[g] = run.get(g, 0) + w
    got = {(r["g"], r["k"]): r["c"] for r in prefix_sum(df, ["g"], "k", "w", "c").collect()}
    assert got == want


@pytest.mark.parametrize("hot, keys", [(1000, 100), (20, 100), (20, 1), (5, 2)])
def test_ranks_keep_every_group(spark, conf, hot, keys):
    import pandas as pd

    conf(hot=hot, keys=keys)
    rows = [(g, k, None if k % 11 == 0 else float((k * 3) % 8)) for k, g in enumerate(GROUPS)]
    got = {(r["g"], r["s"]): (r["rank_min"], r["rank_avg"]) for r in ranks(spark.createDataFrame(rows, "g LONG, s LONG, v DOUBLE"), ["g"], "v", "s").collect()}
    assert len(got) == len(rows)
    for g in set(GROUPS):
        mine = pd.Series({s: v for x, s, v in rows if x == g})
        present = mine.dropna().astype(float)
        for s, low, mean in zip(present.index, present.rank(method="min"), present.rank()):
            assert got[g, s] == (low, mean)
        for k, s in enumerate(mine[mine.isna()].index):
            assert got[g, s] == (len(present) + k + 1,) * 2


def test_ranged_sums_carry_over_partitions(spark, conf):
    """Groups over many partitions, groups that end with a partition, struct and text groups, floating point weights."""
    conf(hot=3)
    rows = [("a" if k % 3 else None, k % 2, k, (k * 7) % 5, k / 8) for k in range(200)] + [("b", 0, k, 1, 0.5) for k in range(2)] + [("z", None, 0, None, None)]
    df = spark.createDataFrame(rows, "g STRING, h INT, k LONG, w LONG, x DOUBLE").repartition(5)
    want, run = {}, {}
    for g, h, k, w, x in sorted(rows, key=lambda r: r[2]):
        a, b = run.get((g, h), (0, 0.0))
        want[g, h, k] = run[g, h] = (a + (w or 0), b + (x or 0.0))
    by_columns = prefix_sum(prefix_sum(df, ["g", "h"], "k", "w", "c"), ["g", "h"], "k", "x", "d")
    assert {(r["g"], r["h"], r["k"]): (r["c"], r["d"]) for r in by_columns.collect()} == want
    packed = df.selectExpr("struct(g, h) AS s", "k", "w")
    out = prefix_sum(packed, ["s"], "k", "w", "c")
    assert out.columns == ["s", "k", "w", "c"]
    assert {(r["s"]["g"], r["s"]["h"], r["k"]): r["c"] for r in out.collect()} == {key: c for key, (c, _) in want.items()}


def test_one_group_of_a_million_rows(spark, conf):
    """A threshold of 100 rows: the work follows the rows, not rows times buckets."""
    conf(hot=100)
    n = 1_000_000
    df = spark.range(n, numPartitions=8).selectExpr("0 AS g", "id * 7919 % 1000003 AS k", "id % 3 AS w", "CAST(id % 50000 AS DOUBLE) AS v")
    out = prefix_sum(df, ["g"], "k", "w", "c")
    assert "_bnd" not in plan(out)
    got = out.agg({"c": "max", "k": "count"}).first()
    assert (got["max(c)"], got["count(k)"]) == (sum(k % 3 for k in range(n)), n)
    checked = out.selectExpr("c - w = coalesce(lag(c) OVER (ORDER BY k), 0) AS ok")
    assert checked.filter("NOT ok").count() == 0
    r = ranks(df, ["g"], "v", "k").selectExpr("rank_min = v * 20 + 1 AND rank_avg = v * 20 + 10.5 AS ok")
    assert r.filter("ok").count() == n


def test_running_count_with_null_and_hot_groups(spark, conf):
    conf(hot=10)
    rows = [(g, k, k % 2) for k, g in enumerate(GROUPS)]
    out = W.running_count(spark.createDataFrame(rows, "g LONG, k LONG, f INT"), ["g"], "k", "f").collect()
    assert len(out) == len(rows)
    for g in set(GROUPS):
        mine = sorted((r["k"], r["cum"]) for r in out if r["g"] == g)
        assert [c for _, c in mine] == list(np.cumsum([k % 2 for k, _ in mine]))


def test_hot_table_is_always_broadcast(spark, conf):
    """With more hot keys than ``maxHotKeys`` the largest are split and neither side is shuffled on the bare key."""
    conf(hot=5, keys=1)
    left = spark.createDataFrame([(k % 3, k) for k in range(60)], "k LONG, a LONG")
    right = spark.createDataFrame([(k % 3, k) for k in range(30)], "k LONG, b LONG")
    out = salted_join(left, right, ["k"])
    assert out.count() == 600
    exchanges = [line for line in plan(out).splitlines() if "hashpartitioning(k" in line]
    assert exchanges and all("_salt_l" in line for line in exchanges)


def test_prepared_join_with_hot_keys(spark, conf):
    conf(hot=5, keys=2)
    big = spark.createDataFrame([(k % 4, k) for k in range(80)], "k LONG, a LONG")
    small = spark.createDataFrame([(k, k * 10) for k in range(4)], "k LONG, b LONG")
    prepared, hot = prepare_repeated_join(big, ["k"], 3)
    got = sorted((r["k"], r["a"], r["b"]) for r in join_prepared(prepared, hot, small, ["k"]).collect())
    assert got == sorted((k % 4, k, (k % 4) * 10) for k in range(80))


def test_indices_above_2_53(spark):
    n = 10**8
    x = Vec(spark.createDataFrame([(n * n - 1, 1.0), (n * n - n, 2.0)], "i LONG, v DOUBLE"), n * n)
    got = sorted((r["i"], r["j"], r["v"]) for r in X.unvec(x, n, n).df.collect())
    assert got == [(0, n - 1, 2.0), (n - 1, n - 1, 1.0)]
    m = S.sprand(spark, 3 * 10**9, 10**9, 3e-18, seed=9)
    assert m.df.filter((m.df.i < 0) | (m.df.i >= m.nrows) | (m.df.j < 0) | (m.df.j >= m.ncols)).count() == 0


@pytest.mark.parametrize("shape", [(2, None), (None, 3), (2, 3), (None, None)])
@pytest.mark.parametrize("use", ["df", "nnz", "shape", "stat", "sample"])
def test_indices_outside_the_shape_raise(spark, shape, use):
    bad = (-3, 0) if shape == (None, None) else (5, 0) if shape[0] else (0, 7)
    df = spark.createDataFrame([(0, 0, 1.0), (*bad, 2.0)], "i LONG, j LONG, v DOUBLE")
    with pytest.raises(PySparkException):
        m = S.from_entries(df, *shape)
        {
            "df": lambda: m.df.collect(),
            "nnz": lambda: A.nnz(m).collect(),
            "shape": lambda: A.shape(m).collect(),
            "stat": lambda: A.stat(m, 1, 1).collect(),
            "sample": lambda: A.block_nnz_sample(m, 1, 1.0, "row").collect(),
        }[use]()


def test_vector_indices_outside_the_size_raise(spark):
    df = spark.createDataFrame([(0, 1.0), (9, 2.0)], "i LONG, v DOUBLE")
    with pytest.raises(PySparkException):
        S.vector_from_entries(df, 3).df.count()


def test_no_nan_is_stored(spark):
    df = spark.createDataFrame([(0, 0, float("nan")), (0, 1, -4.0)], "i LONG, j LONG, v DOUBLE")
    m = S.from_entries(df, 2, 2)
    assert [tuple(r) for r in m.df.collect()] == [(0, 1, -4.0)]
    assert E.power(m, 0.5).df.count() == 0


@pytest.mark.parametrize(
    "parse, lines",
    [
        (TX.parse_edge_lines, ["0 1", "x 2"]),
        (TX.parse_edge_lines, ["0"]),
        (TX.parse_triplet_lines, ["1 1 2", "1 1 y"]),
        (TX.parse_triplet_lines, ["1 b 2"]),
        (lambda t: TX.parse_dense_lines(t, 1, 2), ["q\t1\t2"]),
    ],
)
def test_lines_that_do_not_parse_raise(spark, parse, lines):
    with pytest.raises(PySparkException):
        parse(spark.createDataFrame([(x,) for x in lines], "value STRING")).collect()


@pytest.mark.parametrize("fmt", ["parquet", "tsv", "json"])
def test_save_and_load(spark, tmp_path, fmt):
    a = np.array([[0, 1.5, 0], [2, 0, 0]])
    K.save(mat_from_dense(spark, a), str(tmp_path / "m"), fmt)
    np.testing.assert_allclose(dense(K.load(spark, str(tmp_path / "m"))), a)
    K.save(vec_from_dense(spark, [0, 3.0, 0]), str(tmp_path / "v"), fmt)
    x = K.load(spark, str(tmp_path / "v"))
    assert x.size == 3 and [tuple(r) for r in x.df.collect()] == [(1, 3.0)]


def _expression(spark, rows):
    return spark.createDataFrame(rows, "gene LONG, sample LONG, v DOUBLE")


def test_incomplete_tables_raise(spark):
    expr = [(g, s, float(g + s)) for g in range(2) for s in range(4)]
    geno = spark.createDataFrame([(p, s, (p + s) % 3) for p in range(2) for s in range(4)], "snp LONG, sample LONG, g INT")
    assert Q.kruskal_wallis(_expression(spark, expr), geno, 2, 2, 4).count() == 4
    for broken, snps in ((expr[:-1], geno), (expr[:4], geno), (expr, geno.filter("snp = 0")), (expr, geno.filter("sample > 0"))):
        with pytest.raises(ValueError):
            Q.kruskal_wallis(_expression(spark, broken), snps, 2, 2, 4)


@pytest.mark.parametrize("tile_cells", [1_000_000, 60, 23, 9, 4, 3])
@pytest.mark.parametrize("hot", [1_000_000, 10])
def test_missing_pairs_by_tiles_and_ranges(spark, conf, tile_cells, hot):
    """One piece a gene, and genes cut by ranges of values (runs of ties longer than a piece among them), agree with a direct count."""
    conf(hot=hot)
    rng = np.random.default_rng(4)
    value = lambda g: float(rng.integers(0, 5) if g % 2 else rng.choice([0, 1, 1, 1, 1, 1, 2, 3 + rng.integers(0, 9)]))
    expr = [(g, s, None if rng.random() < 0.2 else value(g)) for g in range(5) for s in range(23)]
    expr += [(7, s, None) for s in range(23)] + [(8, s, 1.5) for s in range(23)]
    geno = [(p, s, None if rng.random() < 0.3 else int(rng.integers(0, 3))) for p in range(6) for s in range(23)]
    out = Q.kruskal_wallis_missing(
        _expression(spark, expr), spark.createDataFrame(geno, "snp LONG, sample LONG, g INT"), 6, 23, tile_cells=tile_cells
    )
    import pandas as pd

    pairs = pd.DataFrame(expr, columns=["gene", "s", "v"]).merge(pd.DataFrame(geno, columns=["snp", "s", "g"]), on="s").dropna()
    want = {}
    for key, t in pairs.groupby(["gene", "snp"]):
        r, k = t.v.rank(), len(t)
        want[key] = 12 / (k * (k + 1)) * sum(r[t.g == x].sum() ** 2 / (t.g == x).sum() for x in set(t.g)) - 3 * (k + 1)
    got = {(r["gene"], r["snp"]): r["stat"] for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_outer_product_forms_only_stored_pairs(spark, conf):
    x = S.vector_from_entries(spark.createDataFrame([(k * 3_000_000, k + 1.0) for k in range(3)], "i LONG, v DOUBLE"), 10**7)
    y = S.vector_from_entries(spark.createDataFrame([(k, 2.0) for k in (5, 9_999_999)], "i LONG, v DOUBLE"), 10**7)
    want = sorted((i * 3_000_000, j, (i + 1) * 2.0) for i in range(3) for j in (5, 9_999_999))
    assert sorted(map(tuple, J.outer_product(x, y).df.collect())) == want
    conf(rows=0)
    out = J.outer_product(x, y).df
    assert sorted(map(tuple, out.collect())) == want
    assert "Range" not in plan(out) and "Cartesian" not in plan(out)


def test_outer_product_follows_entries_not_sizes(spark):
    n = 10**13
    x = Vec(spark.createDataFrame([(0, 2.0), (n - 1, 3.0)], "i LONG, v DOUBLE"), n)
    y = Vec(spark.createDataFrame([(7, 5.0), (n // 2, 1.0)], "i LONG, v DOUBLE"), n)
    assert sorted(map(tuple, J.outer_product(x, y).df.collect())) == [(0, 7, 10.0), (0, n // 2, 2.0), (n - 1, 7, 15.0), (n - 1, n // 2, 3.0)]


def test_outer_product_over_many_blocks(spark, conf, monkeypatch):
    monkeypatch.setattr(J, "OUTER_BLOCK", 3)
    x, y = ([(k * 11 + s, float(k + 1)) for k in range(n)] for n, s in ((17, 0), (10, 5)))
    make = lambda e: Vec(spark.createDataFrame(e, "i LONG, v DOUBLE"), 1000)
    want = sorted((i, j, a * b) for i, a in x for j, b in y)
    assert sorted(map(tuple, J.outer_product(make(x), make(y)).df.collect())) == want
    conf(rows=0)
    assert sorted(map(tuple, J.outer_product(make(x), make(y)).df.collect())) == want
    assert J.outer_product(make(x), Vec(make(y).df.filter("false"), 1000)).df.count() == 0


def test_union_is_a_bag_and_no_matrix(spark):
    a = mat_from_dense(spark, np.ones((2, 2)))
    assert sorted(map(tuple, W.union(a, a).collect())) == sorted([(i, j, 1.0) for i in range(2) for j in range(2)] * 2)


@pytest.mark.parametrize("cells", [1 << 18, 12, 1])
@pytest.mark.parametrize("rows", [None, 0])
def test_tile_product_equals_numpy(spark, conf, cells, rows):
    from tessera.plans import tiles

    if rows is not None:
        conf(rows=rows)
    rng = np.random.default_rng(2)
    a, b = ((rng.random(s) < 0.6) * rng.integers(1, 5, s).astype(float) for s in ((5, 11), (4, 11)))
    side = lambda x: spark.createDataFrame([(int(r), int(k), float(x[r, k])) for r, k in zip(*np.nonzero(x))], "r LONG, k LONG, v DOUBLE")
    got = np.zeros((5, 4))
    for r in tiles.product(side(a), side(b), 5, 4, 11, cells).collect():
        got[r["i"], r["j"]] += r["v"]
    np.testing.assert_allclose(got, a @ b.T)


def test_chain_estimates(spark):
    """Sizes within a fifth of the truth, and the bracket that multiplies least."""
    from tessera.plans import chains

    rng = np.random.default_rng(8)
    mats = [(rng.random(s) < d) * 1.0 for s, d in (((60, 300), 0.05), ((300, 80), 0.03), ((80, 200), 0.05))]
    sizes = chains.ChainSizes([mat_from_dense(spark, m) for m in mats])
    for p, q in ((0, 0), (0, 1), (1, 2), (0, 2)):
        true = np.count_nonzero(np.linalg.multi_dot(mats[p : q + 1]) if q - p > 1 else mats[p] if p == q else mats[p] @ mats[q])
        assert abs(sizes.nnz(p, q) - true) <= 0.2 * true
    column = np.zeros((200, 1))
    column[:20] = 1
    chain = [mat_from_dense(spark, m) for m in (*mats, column)]
    product, bracket = chains.chain_estimated(chain)
    assert bracket == "A(B(CD))"
    np.testing.assert_allclose(dense(product), np.linalg.multi_dot([*mats, column]))


def test_gradient_never_forms_wh(spark):
    """A matrix with one entry: every intermediate has a side of the factors' rank."""
    rng = np.random.default_rng(5)
    v, w, h = np.zeros((30, 40)), rng.integers(1, 4, (30, 2)).astype(float), rng.integers(1, 4, (2, 40)).astype(float)
    v[3, 4] = 5
    g = FZ.gradient(*(mat_from_dense(spark, x) for x in (v, w, h)))
    r = v - w @ h
    want = np.concatenate([(-2 * r @ h.T + 2 * w).ravel(order="F"), (-2 * w.T @ r + 2 * h).ravel(order="F")])
    got = np.zeros(g.size)
    for row in g.df.collect():
        got[row["i"]] = row["v"]
    np.testing.assert_allclose(got, want)
    g.df.write.format("noop").mode("overwrite").save()
    assert "grid" not in plan(g.df)


def test_skewed_lines_that_run_out_raise(spark):
    with pytest.raises(ValueError):
        S.skew_schedule(2, 3, 100, 0.5)


@pytest.mark.parametrize("name", ["random_scale", "random_noise"])
def test_random_matrices_are_checked_cell_by_cell(spark, tmp_path, name):
    """One row for every stored cell of Q, beside the draws' moments over all of them."""
    from tessera import workload as WL

    rows = [(s, p, float(1 + (s * p) % 5)) for s in range(8) for p in range(0, 30, 1 + s % 3)]
    tables = {"lineitem": (rows + rows[:5], "l_suppkey LONG, l_partkey LONG, l_quantity DOUBLE"),
              "supplier": ([(s,) for s in range(8)], "s_suppkey LONG"), "part": ([(p,) for p in range(30)], "p_partkey LONG")}
    for t, (data, kind) in tables.items():
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = WL.REGISTRY[name](spark, str(tmp_path))
    assert got.columns == ["i", "j", "in_range"]
    assert sorted(map(tuple, got.collect())) == sorted((s, p, True) for s, p, _ in rows)
    draws = WL.REGISTRY[f"{name}_draws"](spark, str(tmp_path)).first()
    assert (draws.n, draws.distinct_draws, draws.in_range) == (len(rows), len(rows), True)


def test_outer_product_spreads_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "OUTER_BLOCK", 4)
    x = vec_from_dense(spark, np.arange(1, 21))
    out = J.outer_product(x, x).df
    np.testing.assert_allclose(sum(r.v for r in out.collect()), 210.0**2)
    assert out.rdd.getNumPartitions() > 8


def test_outer_product_leaves_out_no_cell_but_zeros(spark, monkeypatch):
    """Cells are formed by the block, not by a row generator; NULL indices, infinite values and underflow are as for single rows."""
    monkeypatch.setattr(J, "SENT_ROWS", 5)
    x = [(None, 2.0), (0, 1.0), (4, 1e-200), (5, np.inf), (7, None), (8, -3.0)]
    y = [(1, 0.5), (3, 1e-200), (6, 0.0), (None, 4.0)]
    vx, vy = (Vec(spark.createDataFrame(e, "i LONG, v DOUBLE"), 9) for e in (x, y))
    out = J.outer_product(vx, vy).df
    assert "Generate explode(_ys" not in plan(out) and "MapInArrow" in plan(out)
    want = [(i, j, a * b) for i, a in x for j, b in y if a is not None and a * b != 0 and a * b == a * b]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_broadcast_in_parts(spark, conf):
    """A side beyond the broadcast limit by its shape is broadcast whole, or in parts, by its counted entries."""
    rng = np.random.default_rng(7)
    a, b = ((rng.random(s) < 0.3) * rng.integers(-4, 5, s).astype(float) for s in ((12, 9), (9, 14)))
    for limit in (1, 10, 60):
        conf(rows=limit)
        np.testing.assert_allclose(dense(J.matmul_broadcast(mat_from_dense(spark, a), mat_from_dense(spark, b))), a @ b)
