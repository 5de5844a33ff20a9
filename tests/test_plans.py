"""Plan checks: no cartesian products anywhere, broadcasts only where the
shape proves a bound, and scans pruned to the needed columns."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted_plan(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_product(spark, name):
    df = E.queries()[name](spark, SF)
    p = plan_text(df)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_flagship_plan_broadcasts_bounded_side_and_prunes(spark):
    df = E.entry(spark)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p
    formatted = formatted_plan(spark, df)
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in formatted


def test_no_broadcast_without_bound(spark):
    from tessera.operators import algebra as J
    from tessera.sources import tables as T

    spark.conf.set("tessera.broadcast.maxRows", "0")
    try:
        q = T.q_matrix(spark, SF)
        p = plan_text(J.matmul(q, q.T).df)
        assert "BroadcastHashJoin" not in p or "_nsplit" in p
    finally:
        spark.conf.unset("tessera.broadcast.maxRows")


def test_lookup_filter_pushed(spark):
    from tessera.operators import elementwise as El
    from tessera.sources.entries import from_entries

    src = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr(
        "l_suppkey AS i", "l_partkey AS j", "l_quantity AS v"
    )
    m = from_entries(src, 10, 200, unique=True)
    df = El.lookup(m, 3, 7)
    formatted = formatted_plan(spark, df)
    assert "PushedFilters" in formatted and "EqualTo(l_suppkey,3)" in formatted


def test_prepared_data_matrix_is_not_reshuffled(spark):
    """GNMF with factors too large to broadcast: V's cached copy partitioned
    by row feeds the join on the row index with no new Exchange."""
    import numpy as np

    from conftest import mat_from_dense
    from tessera.plans.factorization import _Data, _wide

    spark.conf.set("tessera.broadcast.maxRows", "0")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        data = _Data(mat_from_dense(spark, np.arange(1, 36, dtype=float).reshape(7, 5)), small=False)
        w = _wide(mat_from_dense(spark, np.ones((7, 2))).df, "i", "j", 2)
        lines = plan_text(data.sums(w, "i", 2)).splitlines()
        smj = next(k for k, l in enumerate(lines) if "SortMergeJoin" in l)
        scan = next(k for k, l in enumerate(lines) if "InMemoryTableScan" in l)
        assert smj < scan and not any("Exchange" in l for l in lines[smj:scan])
        data.release()
    finally:
        spark.conf.unset("tessera.broadcast.maxRows")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def joined_rows(spark, df, name="Join"):
    """Rows that the joins of an executed plan put out, one number a join."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if name in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


@pytest.mark.parametrize("small", [True, False])
def test_factor_products_join_each_entry_once(spark, small):
    import numpy as np

    from conftest import mat_from_dense
    from tessera.plans.factorization import _Data, _wide

    v = np.arange(1, 36, dtype=float).reshape(7, 5)
    data = _Data(mat_from_dense(spark, v), small)
    f = np.arange(28, dtype=float).reshape(7, 4)
    out = data.sums(_wide(mat_from_dense(spark, f).df, "i", "j", 4), "i", 4)
    assert joined_rows(spark, out) == [35]
    got = {r["x"]: r["s"] for r in out.collect()}
    np.testing.assert_allclose([got[k] for k in range(5)], v.T @ f)
    data.release()


def test_stationary_product_shuffles_no_partial_product(spark):
    import numpy as np

    from conftest import dense, mat_from_dense
    from tessera.operators import algebra as J

    rng = np.random.default_rng(3)
    a, b = ((rng.random(s) < 0.4) * rng.integers(1, 5, s).astype(float) for s in ((13, 9), (9, 11)))
    a[:, 4], b[4] = 1, 2  # an inner index that all rows and columns share
    x, y = mat_from_dense(spark, a), mat_from_dense(spark, b)
    np.testing.assert_allclose(dense(J.matmul(x, y, strategy="stationary")), a @ b)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        lines = plan_text(J.stationary_plan(x, y, J.product_counts(x, y))).splitlines()
    finally:
        for k in settings:
            spark.conf.set(k, "true")
    join = next(k for k, l in enumerate(lines) if "Join" in l)
    assert not any("Exchange" in l for l in lines[:join])
    assert sum("REPARTITION_BY_NUM" in l for l in lines[join:]) == 2


def test_product_strategy_follows_the_counts(spark):
    import numpy as np

    from conftest import mat_from_dense
    from tessera.operators import algebra as J

    cost = J.product_counts(mat_from_dense(spark, np.ones((6, 5))), mat_from_dense(spark, np.ones((5, 4))))
    assert (cost.left, cost.right, cost.products, cost.widest) == (30, 20, 120, 5)
    many = J.ProductCost(10**9, 10**9, 10**13, 1000, 10**6, 2000)
    assert many.prefers_stationary and many.moved == 10**9 * sum(many.grid)
    assert not J.ProductCost(10**9, 10**9, 10**10, 1000, 10**6, 2000).prefers_stationary  # few products an entry
    assert not J.ProductCost(10**9, 10**9, 10**13, 10**8, 10**6, 2000).prefers_stationary  # a hot row
    spark.conf.set("tessera.broadcast.maxRows", "0")
    try:
        big = mat_from_dense(spark, np.ones((40, 40)))
        assert J.product_counts(big, big).prefers_stationary
        assert "tessera-" in plan_text(J.matmul(big, big).df)  # the written product
    finally:
        spark.conf.unset("tessera.broadcast.maxRows")


@pytest.mark.parametrize("axis", ["row", "col"])
def test_stored_blocks_read_only_their_files(spark, tmp_path, axis):
    import numpy as np

    from conftest import dense, mat_from_dense
    from tessera.operators import aggregates as A
    from tessera.operators import sinks as K

    rng = np.random.default_rng(5)
    a = (rng.random((40, 30)) < 0.5) * rng.integers(1, 9, (40, 30)).astype(float)
    m = mat_from_dense(spark, a)
    K.save_blocks(m, str(tmp_path / "m"), 5, axis)
    stored = K.load_blocks(spark, str(tmp_path / "m"))
    np.testing.assert_allclose(dense(stored.matrix()), a)
    for block, ratio in ((5, 0.4), (10, 0.5), (5, 0.01), (20, 1.0)):
        got = sorted(map(tuple, stored.block_nnz_sample(block, ratio).collect()))
        assert got == sorted(map(tuple, A.block_nnz_sample(m, block, ratio, axis).collect()))
    with pytest.raises(ValueError):
        stored.block_nnz_sample(7, 1.0)
    cells = [(3, 7), (4, 9), (39, 29)]
    assert {(r["i"], r["j"]): r["v"] for r in stored.lookup(cells).collect()} == {c: a[c] for c in cells}

    def files(df):
        text = formatted_plan(spark, df)
        assert "PartitionFilters: [" in text and "blk" in text.split("PartitionFilters: [")[1].split("]")[0]

    files(stored.lookup([(3, 7)]))
    files(stored.block_nnz_sample(5, 0.01))
    hidden = tmp_path / "m"
    wanted = 0 if axis == "row" else 1
    for d in hidden.iterdir():  # without the other blocks' files nothing fails: they are not opened
        if d.name.startswith("blk=") and d.name != f"blk={wanted}":
            for f in d.iterdir():
                if f.name.startswith("part-"):
                    f.write_bytes(b"broken")
    again = K.load_blocks(spark, str(hidden))
    assert [tuple(r) for r in again.lookup([(3, 7)]).collect()] == [(3, 7, a[3, 7])]
    if axis == "row":
        assert [tuple(r) for r in again.block_nnz_sample(5, 0.01).collect()] == [("row", 0, np.count_nonzero(a[:5]))]


def test_eqtl_plans_have_no_row_per_triple(spark):
    """P3, P4 and P5 join tiles: what their joins put out is a row for each pair of blocks (and chunk)."""
    import numpy as np

    from conftest import mat_from_dense
    from tessera.plans import eqtl as Q

    rng = np.random.default_rng(6)
    genes, snps, samples = 6, 7, 20
    expr = spark.createDataFrame([(g, s, float(rng.integers(0, 9))) for g in range(genes) for s in range(samples)], "gene LONG, sample LONG, v DOUBLE")
    geno = spark.createDataFrame([(p, s, int(rng.integers(0, 3))) for p in range(snps) for s in range(samples)], "snp LONG, sample LONG, g INT")
    for out in (
        Q.kruskal_wallis(expr, geno, genes, snps, samples),
        Q.kruskal_wallis_missing(expr, geno, snps, samples),
        Q.eqtl_product(mat_from_dense(spark, np.ones((genes, samples))), mat_from_dense(spark, np.ones((snps, samples)))).df,
    ):
        assert max(joined_rows(spark, out)) <= 4
        assert out.count() == genes * snps


def chain_graph(spark, n=40):
    """A ring with chords and a hub that points to every node."""
    edges = [(k, (k + 1) % n) for k in range(n)] + [(k, (k * 7) % n) for k in range(0, n, 3)] + [(5, k) for k in range(n)]
    return spark.createDataFrame(edges, "src LONG, dst LONG"), edges, n


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_pagerank_moves_neither_side(spark, hot):
    """Three iterations after a cut shuffle nothing but their sums, and the result is that of numpy."""
    import numpy as np

    from tessera.plans import pagerank as PR

    table, edges, n = chain_graph(spark)
    settings = {"tessera.broadcast.maxRows": "0", "spark.sql.adaptive.enabled": "false", "tessera.skew.hotKeyRows": str(hot)}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        P = PR.transition_matrix(table, n)
        steps = PR._CoPartitioned(P.df.selectExpr("i", "j", "v AS pv"))
        assert (steps.hubs is not None) == (hot == 20)
        x = steps.cut(steps.begin(spark.range(n).selectExpr("id AS i", "1.0D AS v")))
        for _ in range(3):
            x = steps.terms(x).groupBy("i").agg({"v": "sum"}).withColumnRenamed("sum(v)", "v")
        lines = plan_text(x).splitlines()
        moved = [l for l in lines if "Exchange hashpartitioning" in l]
        assert len(moved) == 3 if hot > 20 else 3 <= len(moved) and all("hashpartitioning(i" in l for l in moved)
        assert "SortMergeJoin" in plan_text(x)
        got = {r["i"]: r["v"] for r in x.collect()}
        steps.release()
        out = {r["i"]: r["v"] for r in PR.pagerank(P, iterations=7).df.collect()}
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    p = np.zeros((n, n))
    degree = np.bincount([a for a, _ in edges], minlength=n)
    for a, b in edges:
        p[b, a] += 1 / degree[a]
    np.testing.assert_allclose([got.get(k, 0) for k in range(n)], np.linalg.matrix_power(p, 3) @ np.ones(n))
    y = np.ones(n)
    for _ in range(7):
        y = 0.85 * p @ y + 0.15
    np.testing.assert_allclose([out[k] for k in range(n)], y)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tessera_")]
