"""DuckDB oracle SQL for the registered queries (same column names and types).

The derived inputs are written once as CTE fragments; each query is a WITH
clause over the raw tables.  Integer-valued inputs keep sums exact, so most
results compare bit for bit.
"""

from __future__ import annotations

# Derived inputs (see tessera.sources.tables).
CTE = {
    "dims": """dims AS (
  SELECT (SELECT max(s_suppkey) + 1 FROM supplier) AS nsupp,
         (SELECT max(p_partkey) + 1 FROM part) AS npart,
         (SELECT greatest(max(s_nationkey), (SELECT max(n_nationkey) FROM nation)) + 1 FROM supplier) AS nnation,
         (SELECT max(p_size) FROM part) AS psize,
         (SELECT max(vec_id) + 1 FROM embeddings) AS nvec,
         (SELECT max(user_id) + 1 FROM events) AS nusers)""",
    "q": """q AS (
  SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(l_quantity) AS DOUBLE) AS v
  FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0)""",
    "d": """d AS (
  SELECT l_suppkey AS i, l_partkey AS j, CAST(count(*) AS DOUBLE) AS v
  FROM lineitem GROUP BY 1, 2)""",
    "ns": """ns AS (
  SELECT CAST(s_nationkey AS BIGINT) AS i, s_suppkey AS j, CAST(count(*) AS DOUBLE) AS v
  FROM supplier GROUP BY 1, 2)""",
    "ps": """ps AS (
  SELECT p_partkey AS i, CAST(p_size - 1 AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v
  FROM part GROUP BY 1, 2)""",
    "x": """x AS (
  SELECT l_suppkey AS i, CAST(sum(l_quantity) AS DOUBLE) AS v
  FROM lineitem GROUP BY 1 HAVING sum(l_quantity) <> 0)""",
    "y": """y AS (
  SELECT l_suppkey AS i, CAST(sum(l_quantity) AS DOUBLE) AS v
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING sum(l_quantity) <> 0)""",
    "z": """z AS (
  SELECT l_partkey AS i, CAST(sum(l_quantity) AS DOUBLE) AS v
  FROM lineitem GROUP BY 1 HAVING sum(l_quantity) <> 0)""",
    "edges": """edges AS (
  SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)""",
    "em": """em AS (
  SELECT CAST(pos - 1 AS BIGINT) AS i, vec_id AS j, CAST(val AS DOUBLE) AS v
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS val FROM embeddings))""",
    "gm": """gm AS (
  SELECT CAST(s.snp AS BIGINT) AS snp, vec_id AS sample,
         CASE WHEN CAST(embedding[s.snp + 1] AS DOUBLE) < -0.15 THEN NULL
              ELSE CAST(((label * (s.snp + 1) + s.snp) % 3 + 3) % 3 AS INTEGER) END AS g
  FROM embeddings, range(0, 10) AS s(snp))""",
    "gt": """gt AS (
  SELECT CAST(s.snp AS BIGINT) AS snp, vec_id AS sample,
         CAST(((label * (s.snp + 1) + s.snp) % 3 + 3) % 3 AS INTEGER) AS g
  FROM embeddings, range(0, 10) AS s(snp))""",
    "ev": """ev AS (
  WITH sums AS (
    SELECT user_id AS i, CAST(CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) AS BIGINT) AS j,
           round(sum(value), 2) AS v
    FROM events GROUP BY 1, 2),
  span AS (SELECT CAST(max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 AS BIGINT) AS days FROM events),
  cells AS (
    SELECT CAST(r.id // (SELECT days FROM span) AS BIGINT) AS i, CAST(r.id % (SELECT days FROM span) AS BIGINT) AS j
    FROM range(0, (SELECT max(user_id) + 1 FROM events) * (SELECT days FROM span)) AS r(id))
  SELECT c.i, c.j, s.v FROM cells c LEFT JOIN sums s ON c.i = s.i AND c.j = s.j)""",
}

_ORDER = ["dims", "q", "d", "ns", "ps", "x", "y", "z", "edges", "em", "gm", "gt", "ev"]


def with_(names: list[str], body: str) -> str:
    used = [n for n in _ORDER if n in names]
    return "WITH " + ",\n".join(CTE[n] for n in used) + "\n" + body


def mm(a: str, b: str) -> str:
    """Product of two entry tables as a SELECT."""
    return (
        f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {a} a JOIN {b} b ON a.j = b.i "
        f"GROUP BY a.i, b.j HAVING sum(a.v * b.v) <> 0"
    )


SQL: dict[str, str] = {
    "from_entries": with_(["q"], "SELECT i, j, v FROM q"),
    "transpose": with_(["q"], "SELECT j AS i, i AS j, v FROM q"),
    "scale": with_(["q"], "SELECT i, j, v * 2.5 AS v FROM q"),
    "add_scalar": with_(["q"], "SELECT i, j, v - 3.0 AS v FROM q WHERE v - 3.0 <> 0"),
    "power": with_(["q"], "SELECT i, j, pow(v, 2.0) AS v FROM q"),
    "equals_indicator": with_(["q"], "SELECT i, j, 1.0::DOUBLE AS v FROM q WHERE abs(v - 10.0) < 1e-6"),
    "equals_zero": with_(
        ["dims", "ns"],
        """SELECT c.i, c.j, 1.0::DOUBLE AS v FROM (
             SELECT CAST(r.id % (SELECT nnation FROM dims) AS BIGINT) AS i,
                    CAST(r.id // (SELECT nnation FROM dims) AS BIGINT) AS j
             FROM range(0, (SELECT nnation * nsupp FROM dims)) AS r(id)) c
           LEFT JOIN ns ON c.i = ns.i AND c.j = ns.j
           WHERE ns.v IS NULL OR abs(ns.v) < 1e-6""",
    ),
    "row_normalize": with_(
        ["q"], "SELECT i, j, v / sum(abs(v)) OVER (PARTITION BY i) AS v FROM q"
    ),
    "reciprocal": with_(["d"], "SELECT i, j, 2.0 / v AS v FROM d"),
    "divide_scalar": with_(["q"], "SELECT i, j, v / 4.0 AS v FROM q"),
    "map_values": with_(["q"], "SELECT i, j, v - 25 AS v FROM q WHERE v > 25"),
    "lookup": with_(
        ["q"],
        """SELECT k.i, k.j, coalesce(q.v, 0.0) AS v
           FROM (VALUES (3::BIGINT, 7::BIGINT), (0::BIGINT, 0::BIGINT), (5::BIGINT, 11::BIGINT)) k(i, j)
           LEFT JOIN q ON q.i = k.i AND q.j = k.j""",
    ),
    "lookup_vec": with_(
        ["x"],
        """SELECT k.i, coalesce(x.v, 0.0) AS v FROM (VALUES (0::BIGINT), (3::BIGINT), (1000000000000::BIGINT)) k(i)
           LEFT JOIN x ON x.i = k.i""",
    ),
    "scale_vec": with_(["x"], "SELECT i, v * 2.5 AS v FROM x"),
    "divide_vec_scalar": with_(["x"], "SELECT i, v / 4.0 AS v FROM x"),
    "reciprocal_vec": with_(["x"], "SELECT i, 2.0 / v AS v FROM x"),
    "mat_add": with_(
        ["q", "d"],
        "SELECT i, j, sum(v) AS v FROM (SELECT * FROM q UNION ALL SELECT * FROM d) GROUP BY i, j HAVING sum(v) <> 0",
    ),
    "mat_sub": with_(
        ["q", "d"],
        "SELECT i, j, sum(v) AS v FROM (SELECT * FROM q UNION ALL SELECT i, j, -v FROM d) GROUP BY i, j HAVING sum(v) <> 0",
    ),
    "elem_mul": with_(["q", "d"], "SELECT q.i, q.j, q.v * d.v AS v FROM q JOIN d USING (i, j)"),
    "elem_div": with_(["q", "d"], "SELECT q.i, q.j, q.v / d.v AS v FROM q JOIN d USING (i, j)"),
    "divide_vector": with_(
        ["q"],
        """SELECT q.i, q.j, q.v / c.v AS v FROM q
           JOIN (SELECT j, sum(v) AS v FROM q GROUP BY j HAVING sum(v) <> 0) c ON q.j = c.j""",
    ),
    "matmul_gram": with_(["q"], mm("q", "(SELECT j AS i, i AS j, v FROM q)")),
    "matmul_shuffle": with_(["q"], mm("q", "(SELECT j AS i, i AS j, v FROM q)")),
    "matmul_broadcast": with_(["q", "ps"], mm("q", "ps")),
    "matmul_outer": with_(["ns"], mm("(SELECT j AS i, i AS j, v FROM ns)", "ns")),
    "outer_product": with_(["x", "y"], "SELECT x.i, y.i AS j, x.v * y.v AS v FROM x, y WHERE x.v * y.v <> 0"),
    "rank_one_update": with_(
        ["q", "x"],
        f"""SELECT i, j, sum(v) AS v FROM (
              {mm("q", "(SELECT j AS i, i AS j, v FROM q)")}
              UNION ALL SELECT a.i, b.i AS j, a.v * b.v AS v FROM x a, x b)
            GROUP BY i, j HAVING sum(v) <> 0""",
    ),
    "matvec": with_(
        ["q", "z"], "SELECT q.i, sum(q.v * z.v) AS v FROM q JOIN z ON q.j = z.i GROUP BY q.i HAVING sum(q.v * z.v) <> 0"
    ),
    "vecmat": with_(
        ["q", "x"], "SELECT q.j AS i, sum(q.v * x.v) AS v FROM q JOIN x ON q.i = x.i GROUP BY q.j HAVING sum(q.v * x.v) <> 0"
    ),
    "vec_add": with_(
        ["x", "y"], "SELECT i, sum(v) AS v FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY i HAVING sum(v) <> 0"
    ),
    "vec_inner": with_(["x", "y"], "SELECT coalesce(sum(x.v * y.v), 0.0) AS v FROM x JOIN y USING (i)"),
    "axpy": with_(
        ["x", "y"],
        "SELECT i, sum(v) AS v FROM (SELECT i, 2.0 * v AS v FROM x UNION ALL SELECT * FROM y) GROUP BY i HAVING sum(v) <> 0",
    ),
    "gemm": with_(
        ["q", "d", "ps"],
        f"""SELECT i, j, sum(v) AS v FROM (
              SELECT q.i, ps.j, 2.0 * q.v * ps.v AS v FROM q JOIN ps ON q.j = ps.i
              UNION ALL SELECT i, j, 0.5 * v FROM ({mm("d", "ps")}))
            GROUP BY i, j HAVING sum(v) <> 0""",
    ),
    "gemv": with_(
        ["q", "z", "y"],
        """SELECT i, sum(v) AS v FROM (
             SELECT q.i, q.v * z.v * 2.0 AS v FROM q JOIN z ON q.j = z.i
             UNION ALL SELECT i, 3.0 * v FROM y)
           GROUP BY i HAVING sum(v) <> 0""",
    ),
    "row_sums": with_(["q"], "SELECT i, sum(v) AS v FROM q GROUP BY i HAVING sum(v) <> 0"),
    "col_sums": with_(["q"], "SELECT j AS i, sum(v) AS v FROM q GROUP BY j HAVING sum(v) <> 0"),
    "frobenius": with_(["q"], "SELECT sqrt(coalesce(sum(v * v), 0.0)) AS frobenius FROM q"),
    "norms": with_(
        ["x"],
        """SELECT sum(abs(v)) AS l1, sqrt(sum(abs(v) * abs(v))) AS l2, max(abs(v)) AS linf,
                  round(pow(sum(pow(abs(v), 3.0)), 1.0 / 3.0), 6) AS lp FROM x""",
    ),
    "nnz_sparsity": with_(
        ["q", "dims"],
        "SELECT count(*) AS nnz, count(*) / (SELECT CAST(nsupp AS DOUBLE) * npart FROM dims) AS sparsity FROM q",
    ),
    "shape": with_(
        ["q", "dims"],
        """SELECT (SELECT CAST(nsupp AS BIGINT) FROM dims) AS nrows, (SELECT CAST(npart AS BIGINT) FROM dims) AS ncols,
                  CAST(max(i) + 1 AS BIGINT) AS inferred_rows, CAST(max(j) + 1 AS BIGINT) AS inferred_cols FROM q""",
    ),
    "block_nnz_sample": with_(
        ["q", "dims"],
        """, p AS (
             SELECT ceil(nsupp / 10.0)::BIGINT AS nbr, ceil(npart / 100.0)::BIGINT AS nbc FROM dims),
           s AS (
             SELECT nbr, nbc,
                    greatest(floor(0.3 * nbr), 1)::BIGINT AS kr, greatest(floor(0.3 * nbc), 1)::BIGINT AS kc FROM p),
           st AS (SELECT kr, kc, greatest(nbr // kr, 1) AS sr, greatest(nbc // kc, 1) AS sc FROM s)
           SELECT 'row' AS axis, i // 10 AS block, count(*) AS nnz FROM q, st
             WHERE (i // 10) % sr = 0 AND (i // 10) // sr < kr GROUP BY 1, 2
           UNION ALL
           SELECT 'col' AS axis, j // 100 AS block, count(*) AS nnz FROM q, st
             WHERE (j // 100) % sc = 0 AND (j // 100) // sc < kc GROUP BY 1, 2""",
    ),
    "product_cost": with_(
        ["q"],
        """SELECT CAST(coalesce(sum(a.n * b.n), 0) AS BIGINT) AS cost FROM
             (SELECT j // 100 AS k, count(*) AS n FROM q GROUP BY 1) a
             JOIN (SELECT j // 100 AS k, count(*) AS n FROM q GROUP BY 1) b USING (k)""",
    ),
    "out_degree": with_(
        ["edges"], "SELECT src AS i, dst AS j, 1.0 / count(*) OVER (PARTITION BY src) AS v FROM edges"
    ),
    "vec_op": with_(["ns", "dims"], "SELECT j * (SELECT nnation FROM dims) + i AS i, v FROM ns"),
    "vec_stack": with_(
        ["x", "z", "dims"], "SELECT i, v FROM x UNION ALL SELECT i + (SELECT nsupp FROM dims) AS i, v FROM z"
    ),
    "hconcat": with_(
        ["q", "d", "dims"], "SELECT i, j, v FROM q UNION ALL SELECT i, j + (SELECT npart FROM dims) AS j, v FROM d"
    ),
    "vconcat": with_(
        ["q", "d", "dims"], "SELECT i, j, v FROM q UNION ALL SELECT i + (SELECT nsupp FROM dims) AS i, j, v FROM d"
    ),
    "densify": with_(
        ["dims", "ns"],
        """SELECT c.i, c.j, coalesce(ns.v, 0.0) AS v FROM (
             SELECT CAST(r.id % (SELECT nnation FROM dims) AS BIGINT) AS i,
                    CAST(r.id // (SELECT nnation FROM dims) AS BIGINT) AS j
             FROM range(0, (SELECT nnation * nsupp FROM dims)) AS r(id)) c
           LEFT JOIN ns ON c.i = ns.i AND c.j = ns.j""",
    ),
    "block_cyclic": with_(
        ["q"],
        """SELECT ((i // 10) % 2) * 3 + (j // 100) % 3 AS part, count(*) AS n, sum(v) AS total
           FROM q GROUP BY 1""",
    ),
    "range_partition": with_(["q"], "SELECT count(*) AS n, true AS apart, true AS even FROM q"),
    "rank_avg": with_(
        ["ev"],
        """SELECT i, j, v, CAST(CASE WHEN v IS NULL
                 THEN count(v) OVER (PARTITION BY i) + row_number() OVER (PARTITION BY i, v IS NULL ORDER BY j)
                 ELSE rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0
               END AS DOUBLE) AS rank FROM ev""",
    ),
    "rank_min": with_(
        ["ev"],
        """SELECT i, j, v, CAST(CASE WHEN v IS NULL
                 THEN count(v) OVER (PARTITION BY i) + row_number() OVER (PARTITION BY i, v IS NULL ORDER BY j)
                 ELSE rank() OVER (PARTITION BY i ORDER BY v)
               END AS DOUBLE) AS rank FROM ev""",
    ),
    "rank_expression": with_(
        ["em"],
        """SELECT i, j, v, CAST(rank() OVER (PARTITION BY i ORDER BY v)
                 + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0 AS DOUBLE) AS rank FROM em""",
    ),
    "running_missing": with_(
        ["em", "gm"],
        """SELECT e.i AS g, gm.snp, gm.sample,
                  CAST(sum(CASE WHEN gm.g IS NULL THEN 1 ELSE 0 END)
                    OVER (PARTITION BY e.i, gm.snp ORDER BY e.v, e.j ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
           FROM em e JOIN gm ON e.j = gm.sample""",
    ),
    "matmul_salted": with_(["q"], mm("q", "(SELECT j AS i, i AS j, v FROM q)")),
    "matmul_stationary": with_(["q"], mm("q", "(SELECT j AS i, i AS j, v FROM q)")),
    "running_hot_group": """SELECT g, event_id, CAST(sum(flag) OVER (PARTITION BY g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
        FROM (SELECT CASE WHEN user_id % 3 < 2 THEN user_id % 3 END AS g, event_id, CASE WHEN value > 0.5 THEN 1 ELSE 0 END AS flag
              FROM events)""",
    "topk_entries": with_(["q"], "SELECT i, j, v FROM q ORDER BY v DESC, i, j LIMIT 10"),
    "topk_vector": with_(["x"], "SELECT i, v FROM x ORDER BY v DESC, i LIMIT 5"),
    "union": with_(["q", "d"], "SELECT i, j, v FROM q UNION ALL SELECT i, j, v FROM d"),
}


SQL["rank_hot_group"] = SQL["rank_avg"]


# ---------------------------------------------------------------------------
# Pipelines: generated SQL (iterations unrolled as a CTE chain)
# ---------------------------------------------------------------------------


def _t(name: str) -> str:
    return f"(SELECT j AS i, i AS j, v FROM {name})"


def _formula(name: str, rows: str, cols: str, a: int, b: int, mod: int, offset: float) -> str:
    """Dense initialiser offset + (a*i + b*j) mod m over a rows x cols grid."""
    return f"""{name} AS (
  SELECT i, j, v FROM (
    SELECT CAST(r.id % ({rows}) AS BIGINT) AS i, CAST(r.id // ({rows}) AS BIGINT) AS j,
           CAST({offset} + ({a} * (r.id % ({rows})) + {b} * (r.id // ({rows}))) % {mod} AS DOUBLE) AS v
    FROM range(0, ({rows}) * ({cols})) AS r(id)) WHERE v <> 0)"""


def _pagerank_sql(iterations: int = 10, alpha: float = 0.85, top: int | None = None) -> str:
    parts = [
        CTE["dims"],
        CTE["edges"],
        """deg AS (SELECT src, count(*) AS c FROM edges GROUP BY src)""",
        """p AS (SELECT e.dst AS i, e.src AS j, sum(1.0 / d.c) AS v
                 FROM edges e JOIN deg d USING (src) GROUP BY 1, 2 HAVING sum(1.0 / d.c) <> 0)""",
        """tele AS (SELECT r.id AS i, 1.0 AS v FROM range(0, (SELECT greatest(nsupp, npart) FROM dims)) r(id))""",
        """x0 AS (SELECT i, v FROM tele)""",
    ]
    for t in range(1, iterations + 1):
        parts.append(
            f"""x{t} AS (SELECT i, sum(v) AS v FROM (
                 SELECT p.i, ({alpha} * p.v) * x.v AS v FROM p JOIN x{t - 1} x ON p.j = x.i
                 UNION ALL SELECT i, v * {1.0 - alpha} FROM tele) GROUP BY i HAVING sum(v) <> 0)"""
        )
    body = f"SELECT i, round(v, 6) AS v FROM x{iterations}"
    if top:
        body = f"SELECT i, round(v, 6) AS v FROM x{iterations} ORDER BY v DESC, i LIMIT {top}"
    return "WITH " + ",\n".join(parts) + "\n" + body


_RANKS = """r AS (
  SELECT i AS gene, j AS sample,
         rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0 AS r
  FROM em)"""


def _kw_stat(k: str) -> str:
    return f"""round(12.0 / ({k} * ({k} + 1.0)) * (
        CASE WHEN n0 > 0 THEN s0 * s0 / n0 ELSE 0.0 END +
        CASE WHEN n1 > 0 THEN s1 * s1 / n1 ELSE 0.0 END +
        CASE WHEN n2 > 0 THEN s2 * s2 / n2 ELSE 0.0 END) - 3.0 * ({k} + 1.0), 6)"""


def _kw_sql(genotypes: str = "gt", missing: bool = False) -> str:
    """P3; with ``missing`` a missing call counts as genotype 0."""
    geno = "gt0 AS (SELECT snp, sample, coalesce(g, 0) AS g FROM gm)" if missing else "gt0 AS (SELECT * FROM gt)"
    return with_(
        ["dims", "em", genotypes],
        f""", {geno}, {_RANKS},
  s AS (SELECT r.gene, gt0.snp,
               coalesce(sum(CASE WHEN gt0.g = 1 THEN r.r END), 0.0) AS s1,
               coalesce(sum(CASE WHEN gt0.g = 2 THEN r.r END), 0.0) AS s2
        FROM r JOIN gt0 ON r.sample = gt0.sample GROUP BY 1, 2),
  n AS (SELECT snp, count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 2) AS n2 FROM gt0 GROUP BY snp),
  k AS (SELECT CAST(nvec AS DOUBLE) AS k FROM dims),
  t AS (SELECT s.gene, s.snp, (SELECT k FROM k) AS kk,
               (SELECT k FROM k) * ((SELECT k FROM k) + 1) / 2.0 - s1 - s2 AS s0,
               (SELECT k FROM k) - n1 - n2 AS n0, s1, n1, s2, n2
        FROM s JOIN n USING (snp))
SELECT gene, snp, {_kw_stat("kk")} AS stat FROM t""",
    )


def _kw_missing_sql(expression: str = "em.v IS NOT NULL") -> str:
    return with_(
        ["em", "gm"],
        f""", pr AS (
    SELECT em.i AS gene, gm.snp, em.j AS sample, em.v, gm.g,
           rank() OVER (PARTITION BY em.i, gm.snp ORDER BY em.v)
             + (count(*) OVER (PARTITION BY em.i, gm.snp, em.v) - 1) / 2.0 AS r
    FROM em JOIN gm ON em.j = gm.sample WHERE gm.g IS NOT NULL AND {expression}),
  t AS (SELECT gene, snp, CAST(count(*) AS DOUBLE) AS k,
               coalesce(sum(CASE WHEN g = 0 THEN r END), 0.0) AS s0,
               coalesce(sum(CASE WHEN g = 1 THEN r END), 0.0) AS s1,
               coalesce(sum(CASE WHEN g = 2 THEN r END), 0.0) AS s2,
               count(*) FILTER (WHERE g = 0) AS n0, count(*) FILTER (WHERE g = 1) AS n1,
               count(*) FILTER (WHERE g = 2) AS n2
        FROM pr GROUP BY 1, 2)
SELECT gene, snp, {_kw_stat("k")} AS stat FROM t""",
    )


def _gnmf_sql(iterations: int) -> str:
    parts = [
        CTE["dims"],
        CTE["q"],
        "vv AS MATERIALIZED (SELECT i, j, v FROM q)",
        _formula("w0", "(SELECT nsupp FROM dims)", "5", 31, 17, 7, 1.0),
        _formula("h0", "5", "(SELECT npart FROM dims)", 31, 17, 7, 1.0),
    ]
    for t in range(1, iterations + 1):
        p = t - 1
        parts += [
            f"a{t} AS ({mm(_t(f'w{p}'), 'vv')})",
            f"g{t} AS ({mm(_t(f'w{p}'), f'w{p}')})",
            f"b{t} AS ({mm(f'g{t}', f'h{p}')})",
            f"""h{t} AS MATERIALIZED (SELECT i, j, v FROM (
                  SELECT h.i, h.j, (h.v * a.v) / (b.v + 1e-8) AS v
                  FROM h{p} h JOIN a{t} a USING (i, j) JOIN b{t} b USING (i, j)) WHERE v <> 0)""",
            f"c{t} AS ({mm('vv', _t(f'h{t}'))})",
            f"e{t} AS ({mm(f'h{t}', _t(f'h{t}'))})",
            f"f{t} AS ({mm(f'w{p}', f'e{t}')})",
            f"""w{t} AS MATERIALIZED (SELECT i, j, v FROM (
                  SELECT w.i, w.j, (w.v * c.v) / (f.v + 1e-8) AS v
                  FROM w{p} w JOIN c{t} c USING (i, j) JOIN f{t} f USING (i, j)) WHERE v <> 0)""",
        ]
    n = iterations
    body = (
        f"SELECT 'W' AS mat, i, j, round(v, 6) AS v FROM w{n} "
        f"UNION ALL SELECT 'H' AS mat, i, j, round(v, 6) AS v FROM h{n}"
    )
    return "WITH " + ",\n".join(parts) + "\n" + body


def _gradient_parts(tag: str, a: int, b: int) -> list[str]:
    """CTEs for the stacked gradient g{tag} with factors from formula (a, b)."""
    return [
        _formula(f"w{tag}", "(SELECT nnation FROM dims)", "2", a, b, 3, 0.0),
        _formula(f"h{tag}", "2", "(SELECT nsupp FROM dims)", a, b, 3, 0.0),
        f"wh{tag} AS ({mm(f'w{tag}', f'h{tag}')})",
        f"""r{tag} AS (SELECT i, j, sum(v) AS v FROM (SELECT * FROM ns UNION ALL SELECT i, j, -v FROM wh{tag})
                  GROUP BY i, j HAVING sum(v) <> 0)""",
        f"""dw{tag} AS (SELECT i, j, sum(v) AS v FROM (
                  SELECT i, j, v * -2.0 AS v FROM ({mm(f'r{tag}', _t(f'h{tag}'))})
                  UNION ALL SELECT i, j, v * 2.0 FROM w{tag}) GROUP BY i, j HAVING sum(v) <> 0)""",
        f"""dh{tag} AS (SELECT i, j, sum(v) AS v FROM (
                  SELECT i, j, v * -2.0 AS v FROM ({mm(_t(f'w{tag}'), f'r{tag}')})
                  UNION ALL SELECT i, j, v * 2.0 FROM h{tag}) GROUP BY i, j HAVING sum(v) <> 0)""",
        f"""g{tag} AS (SELECT j * (SELECT nnation FROM dims) + i AS i, v FROM dw{tag}
                  UNION ALL SELECT (SELECT nnation FROM dims) * 2 + j * 2 + i AS i, v FROM dh{tag})""",
    ]


def _gradient_sql() -> str:
    parts = [CTE["dims"], CTE["ns"]] + _gradient_parts("1", 31, 17)
    return "WITH " + ",\n".join(parts) + "\nSELECT i, v FROM g1"


def _bfgs_sql(scaled: bool = False) -> str:
    n = "((SELECT nnation FROM dims) * 2 + 2 * (SELECT nsupp FROM dims))"
    parts = [CTE["dims"], CTE["ns"]] + _gradient_parts("1", 31, 17) + _gradient_parts("2", 14, 28)
    parts += [
        _formula("b0", n, n, 7, 3, 11, 1.0),
        "s AS (SELECT i, -v AS v FROM g1)",
        """y AS (SELECT i, sum(v) AS v FROM (SELECT * FROM g2 UNION ALL SELECT i, -v FROM g1)
                GROUP BY i HAVING sum(v) <> 0)""",
        """bs AS (SELECT b.i, sum(b.v * s.v) AS v FROM b0 b JOIN s ON b.j = s.i GROUP BY b.i HAVING sum(b.v * s.v) <> 0)""",
        """sb AS (SELECT b.j AS i, sum(b.v * s.v) AS v FROM b0 b JOIN s ON b.i = s.i GROUP BY b.j HAVING sum(b.v * s.v) <> 0)""",
    ]
    a, b, value = "1.0", "1.0", "sum(v)"
    if scaled:
        parts += [
            "ys AS (SELECT sum(y.v * s.v) AS v FROM y JOIN s USING (i))",
            "sbs AS (SELECT sum(s.v * bs.v) AS v FROM s JOIN bs USING (i))",
        ]
        a, b, value = "(1.0 / (SELECT v FROM ys))", "(1.0 / (SELECT v FROM sbs))", "round(sum(v), 6)"
    body = f"""SELECT i, j, {value} AS v FROM (
        SELECT i, j, v FROM b0
        UNION ALL SELECT a.i, b.i AS j, (a.v * b.v) * {a} FROM y a, y b
        UNION ALL SELECT a.i, b.i AS j, (a.v * b.v) * -{b} FROM bs a, sb b)
      GROUP BY i, j HAVING sum(v) <> 0"""
    return "WITH " + ",\n".join(parts) + "\n" + body


def _chain_sql() -> str:
    return with_(["q", "ns", "ps"], f", nq AS ({mm('ns', 'q')}), nqp AS ({mm('nq', 'ps')})\n" + mm("nqp", _t("ps")))


def _chain_bracket_sql() -> str:
    """P10's greedy choice over (NS, Q, PS, PSᵀ): sampled costs of the three pairs, then of the two pairs that the first
    product leaves.  The first of equal costs wins."""
    ops = {"a": "ns", "b": "q", "c": "ps", "e": _t("ps")}
    dims_of = {"a": ("nnation", "nsupp"), "b": ("nsupp", "npart"), "c": ("npart", "psize"), "e": ("psize", "npart")}
    parts = []

    def counts(name: str, source: str, rows: str, cols: str, ratio: float) -> None:
        for axis, idx, dim in (("r", "i", rows), ("c", "j", cols)):
            parts.append(
                f"""{name}_{axis} AS (
  SELECT {idx} // 100 AS k, count(*) AS n
  FROM {source}, (SELECT n, greatest(CAST(floor({ratio} * n) AS BIGINT), 1) AS m
                  FROM (SELECT CAST(({dim} + 99) // 100 AS BIGINT) AS n FROM dims)) s
  WHERE ({idx} // 100) % greatest(s.n // s.m, 1) = 0 AND ({idx} // 100) // greatest(s.n // s.m, 1) < s.m GROUP BY 1)"""
            )

    def cost(x: str, y: str) -> str:
        return f"(SELECT coalesce(sum(l.n * r.n), 0) FROM {x}_c l JOIN {y}_r r USING (k))"

    for name, source in ops.items():
        counts(name, source, *dims_of[name], 0.01)
    for x, y in ("ab", "bc", "ce"):
        parts.append(f"{x}{y} AS ({mm(ops[x], ops[y])})")
        counts(x + y, x + y, dims_of[x][0], dims_of[y][1], 0.1)
    parts.append(f"cost AS (SELECT {cost('a', 'b')} AS ab, {cost('b', 'c')} AS bc, {cost('c', 'e')} AS cd)")
    body = f"""SELECT CASE
      WHEN ab <= bc AND ab <= cd THEN CASE WHEN {cost('ab', 'c')} <= cd THEN '((AB)C)D' ELSE '(AB)(CD)' END
      WHEN bc <= cd THEN CASE WHEN {cost('a', 'bc')} <= {cost('bc', 'e')} THEN '(A(BC))D' ELSE 'A((BC)D)' END
      ELSE CASE WHEN ab <= {cost('b', 'ce')} THEN '(AB)(CD)' ELSE 'A(B(CD))' END END AS bracket FROM cost"""
    return with_(["dims", "q", "ns", "ps"], ", " + ",\n".join(parts) + "\n" + body)


SQL["lookup_stored"] = SQL["lookup"]
SQL["block_nnz_stored"] = SQL["block_nnz_sample"]

SQL.update(
    {
        "transition_matrix": with_(
            ["edges"],
            """, deg AS (SELECT src, count(*) AS c FROM edges GROUP BY src)
               SELECT e.dst AS i, e.src AS j, sum(1.0 / d.c) AS v FROM edges e JOIN deg d USING (src)
               GROUP BY 1, 2 HAVING sum(1.0 / d.c) <> 0""",
        ),
        "pagerank": _pagerank_sql(10),
        "pagerank_top5": _pagerank_sql(10, top=5),
        "kruskal_wallis": _kw_sql(),
        "kruskal_wallis_zero_coded": _kw_sql("gm", missing=True),
        "kruskal_wallis_missing": _kw_missing_sql(),
        "kruskal_wallis_missing_both": _kw_missing_sql("em.v <= 0.2"),
        "eqtl_product": with_(
            ["em", "gt"],
            """SELECT em.i, gt.snp AS j, round(sum(em.v * gt.g), 6) AS v
               FROM em JOIN gt ON em.j = gt.sample WHERE gt.g <> 0
               GROUP BY 1, 2 HAVING sum(em.v * gt.g) <> 0""",
        ),
        "gnmf_step": _gnmf_sql(1),
        "gnmf": _gnmf_sql(10),
        "factor_gradient": _gradient_sql(),
        "bfgs_step": _bfgs_sql(),
        "bfgs_step_scaled": _bfgs_sql(scaled=True),
        "chain_fixed": _chain_sql(),
        "chain_cost_ordered": _chain_sql(),
        "chain_estimated": _chain_sql(),
        "chain_sizes": with_(
            ["q", "ps"],
            f""", ab AS ({mm('q', 'ps')}), abc AS ({mm('ab', '(SELECT j AS i, i AS j, v FROM ps)')})
            SELECT 'AB' AS chain, count(*) AS nnz, true AS near FROM ab UNION ALL SELECT 'ABC', count(*), true FROM abc""",
        ),
        **{name: _chain_sql() for name in ("chain_left", "chain_left_inner", "chain_right_inner", "chain_right")},
        "chain_three": with_(["q", "ns", "ps"], f", nq AS ({mm('ns', 'q')})\n" + mm("nq", "ps")),
        "chain_bracket": _chain_bracket_sql(),
    }
)


# S16 schedule as a recursive CTE: line k takes
# c = least(greatest(least(floor(r * 0.5), width), 1), r), r -= c.
_SKEW = """RECURSIVE dims AS (
  SELECT (SELECT max(s_suppkey) + 1 FROM supplier) AS nsupp,
         (SELECT max(p_partkey) + 1 FROM part) AS npart),
tot AS (SELECT nsupp AS lines, npart AS width, CAST(floor(nsupp * npart * 0.125) AS BIGINT) AS total FROM dims),
s(k, r, c) AS (
  SELECT 0::BIGINT, total, least(greatest(least(CAST(floor(total * 0.5) AS BIGINT), width), 1), total) FROM tot
  UNION ALL
  SELECT k + 1, r - c, least(greatest(least(CAST(floor((r - c) * 0.5) AS BIGINT), width), 1), r - c)
  FROM s, tot WHERE r - c > 0 AND k + 1 < lines)"""

SQL.update(
    {
        "edge_list_text": with_(["d"], "SELECT i, j, v FROM d"),
        "triplets_text": with_(["q"], "SELECT i, j, v FROM q"),
        "dense_text": with_(["em"], "SELECT j AS i, i AS j, v FROM em"),
        "dense_text_wide": with_(["em"], "SELECT j AS i, i AS j, v FROM em"),
        "genotype_text": with_(["gm"], "SELECT snp, sample, g FROM gm"),
        "genotype_text_wide": with_(["gm"], "SELECT snp, sample, g FROM gm"),
        "row_layout": with_(
            ["q"],
            "SELECT i, count(*) AS nnz, min(j) AS first_j, max(j) AS last_j, sum(v) AS total FROM q GROUP BY i",
        ),
        "column_layout": with_(
            ["q"],
            "SELECT j, count(*) AS nnz, min(i) AS first_i, max(i) AS last_i, sum(v) AS total FROM q GROUP BY j",
        ),
        "zeros_add": with_(["q"], "SELECT i, j, v FROM q"),
        "ones_product": with_(
            ["q"],
            "SELECT q.i, CAST(c.j AS BIGINT) AS j, sum(q.v) AS v FROM q, range(0, 3) c(j) GROUP BY q.i, c.j HAVING sum(q.v) <> 0",
        ),
        "ones_index": "SELECT DISTINCT l_suppkey AS i, 1.0::DOUBLE AS v FROM lineitem WHERE l_returnflag = 'R'",
        "ones_columns": with_(["q"], "SELECT i, sum(v) AS v FROM q GROUP BY i HAVING sum(v) <> 0"),
        "identity_product": with_(["q"], "SELECT i, j, v FROM q"),
        "diag_scale": with_(["q", "x"], "SELECT q.i, q.j, x.v * q.v AS v FROM q JOIN x ON q.i = x.i"),
        "column_major": with_(["em"], "SELECT i, j, v FROM em WHERE v <> 0"),
        "skewed_lines": f"""WITH {_SKEW},
        {CTE["q"]},
        n AS (SELECT i, count(*) AS n FROM q GROUP BY i)
        SELECT coalesce(k, i) AS line, coalesce(c, 0) AS cnt, coalesce(n, 0) AS q_nnz, 0::BIGINT AS out_of_range
        FROM s FULL JOIN n ON s.k = n.i""",
        "random_scale": with_(["q"], "SELECT i, j, true AS in_range FROM q"),
        "random_scale_draws": with_(["q"], "SELECT count(*) AS n, count(*) AS distinct_draws, true AS in_range, true AS mean_fits, true AS variance_fits, true AS half_above FROM q"),
        "random_noise": with_(["q"], "SELECT i, j, true AS in_range FROM q"),
        "random_noise_draws": with_(["q"], "SELECT count(*) AS n, count(*) AS distinct_draws, true AS in_range, true AS mean_fits, true AS variance_fits, true AS half_above FROM q"),
        "random_mask": with_(
            ["dims", "q"],
            """SELECT kind, (SELECT CAST(ceil(nsupp * npart * 0.125) AS BIGINT) FROM dims) AS mask,
                      (SELECT count(*) FROM q) AS q_nnz, 1::BIGINT AS most, true AS split
               FROM (VALUES ('uniform'), ('normal')) k(kind)""",
        ),
        "stat": with_(
            ["dims", "q"],
            """SELECT CAST(nsupp AS BIGINT) AS nrows, CAST(npart AS BIGINT) AS ncols,
                      CAST(ceil(nsupp / 10) AS BIGINT) AS row_blocks, CAST(ceil(npart / 500) AS BIGINT) AS col_blocks,
                      10::BIGINT AS rows_per_block, 500::BIGINT AS cols_per_block,
                      (SELECT count(*) FROM q) AS nnz,
                      (SELECT count(*) FROM (SELECT DISTINCT i // 10, j // 500 FROM q)) AS stored_blocks
               FROM dims""",
        ),
        "validate": with_(
            ["q", "d"],
            """SELECT (SELECT count(*) FROM q) + (SELECT count(*) FROM d) AS nnz,
                      (SELECT count(*) FROM q JOIN d USING (i, j)) AS duplicate_keys,
                      0::BIGINT AS out_of_shape, 0::BIGINT AS zeros, 0::BIGINT AS nulls""",
        ),
        "partition_by_axis": with_(
            ["q"],
            """SELECT 'row' AS axis, i AS k, count(*) AS nnz, 1::BIGINT AS n_parts FROM q GROUP BY i
               UNION ALL SELECT 'col' AS axis, j AS k, count(*) AS nnz, 1::BIGINT AS n_parts FROM q GROUP BY j
               UNION ALL SELECT 'expr' AS axis, (i + j) % 8 AS k, count(*) AS nnz, 1::BIGINT AS n_parts FROM q GROUP BY 2""",
        ),
    }
)
