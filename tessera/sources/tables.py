"""Matrices and vectors derived from the driver's parquet tables.

Every reader selects only the columns it needs, so the parquet scan's
``ReadSchema`` is pruned and filters are pushed into the scan.  Shapes come
from the key ranges of the tables that own the keys (one aggregate over one
column each, only those a query needs).

| name | definition |
| --- | --- |
| Q | sum(l_quantity) by (l_suppkey, l_partkey) |
| D | count(*) by (l_suppkey, l_partkey) |
| NS | 1 at (s_nationkey, s_suppkey) |
| PS | 1 at (p_partkey, p_size - 1) |
| x, y | l_suppkey -> sum(l_quantity); y only l_returnflag = 'R' |
| z | l_partkey -> sum(l_quantity) |
| edges | distinct l_suppkey -> l_partkey, shared id space |
| EM | embedding component ``pos`` of ``vec_id``: genes = positions, samples = vec_id |
| G | genotype (label*(m+1)+m) mod 3 for SNP m in 0..9, samples = vec_id |
| GM | G with a missing call where the sample's embedding component m < -0.15 |
| EV | round(sum(value), 2) by (user_id, days since the first event), NULL on days without events |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import Mat, Vec, idiv, spread
from tessera.sources.entries import from_entries, vector_from_entries

N_SNPS = 10


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


# Dimension -> (table that owns the key, column, expression of the size).
_DIMS = {
    "supp": ("supplier", "s_suppkey", lambda c: F.max(c) + 1),
    "nation": ("nation", "n_nationkey", lambda c: F.max(c) + 1),
    "part": ("part", "p_partkey", lambda c: F.max(c) + 1),
    "psize": ("part", "p_size", F.max),
    "vec": ("embeddings", "vec_id", lambda c: F.max(c) + 1),
    "dim": ("embeddings", "embedding", lambda c: F.max(F.size(c))),
    "users": ("events", "user_id", lambda c: F.max(c) + 1),
}


class Dims:
    """Sizes of the key ranges of a folder, each read when it is asked for: one aggregate over
    one column of the table that owns the key.  Nothing outlives the query that asks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    def __getitem__(self, name: str) -> int:
        if name not in self.known:
            owner, column, size = _DIMS[name]
            self.known[name] = int(table(self.spark, self.sf_dir, owner, column).agg(size(column)).first()[0] or 0)
        return self.known[name]


def dims(spark: SparkSession, sf_dir: str) -> Dims:
    return Dims(spark, sf_dir)


def q_matrix(spark: SparkSession, sf_dir: str) -> Mat:
    d = dims(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_quantity")
    e = li.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return from_entries(e, d["supp"], d["part"], rows=li.count())


def d_matrix(spark: SparkSession, sf_dir: str) -> Mat:
    d = dims(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")
    e = li.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.lit(1.0).alias("v"))
    return from_entries(e, d["supp"], d["part"], rows=li.count())


def ns_matrix(spark: SparkSession, sf_dir: str) -> Mat:
    d = dims(spark, sf_dir)
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    e = s.select(F.col("s_nationkey").alias("i"), F.col("s_suppkey").alias("j"), F.lit(1.0).alias("v"))
    return from_entries(e, d["nation"], d["supp"])


def ps_matrix(spark: SparkSession, sf_dir: str) -> Mat:
    d = dims(spark, sf_dir)
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    e = p.select(F.col("p_partkey").alias("i"), (F.col("p_size") - 1).alias("j"), F.lit(1.0).alias("v"))
    return from_entries(e, d["part"], d["psize"])


def x_vector(spark: SparkSession, sf_dir: str, returned_only: bool = False) -> Vec:
    d = dims(spark, sf_dir)
    cols = ["l_suppkey", "l_quantity"] + (["l_returnflag"] if returned_only else [])
    li = table(spark, sf_dir, "lineitem", *cols)
    if returned_only:
        li = li.filter(F.col("l_returnflag") == "R")
    return vector_from_entries(li.select(F.col("l_suppkey").alias("i"), F.col("l_quantity").alias("v")), d["supp"])


def z_vector(spark: SparkSession, sf_dir: str) -> Vec:
    d = dims(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity")
    return vector_from_entries(li.select(F.col("l_partkey").alias("i"), F.col("l_quantity").alias("v")), d["part"])


def edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Distinct supplier -> part edges; node count = max id + 1 over both."""
    d = dims(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")
    e = li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    e = spread(e, li.count(), "src", "dst").distinct()
    return e, max(d["supp"], d["part"])


def em_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete expression table ``(i gene, j sample, v)``."""
    em = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return em.select(F.posexplode("embedding").alias("i", "v"), "vec_id").select(
        F.col("i").cast("long").alias("i"), F.col("vec_id").alias("j"), F.col("v").cast("double").alias("v")
    )


def genotype_table(spark: SparkSession, sf_dir: str, with_missing: bool = False) -> DataFrame:
    """Genotype ``(snp, sample, g)``; ``g`` NULL marks a missing call."""
    em = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    m = F.explode(F.sequence(F.lit(0), F.lit(N_SNPS - 1))).alias("snp")
    t = em.select("vec_id", "label", "embedding", m)
    g = F.pmod(F.col("label") * (F.col("snp") + 1) + F.col("snp"), F.lit(3)).cast("int")
    if with_missing:
        comp = F.element_at(F.col("embedding"), (F.col("snp") + 1).cast("int")).cast("double")
        g = F.when(comp < F.lit(-0.15), F.lit(None).cast("int")).otherwise(g)
    return t.select(F.col("snp").cast("long").alias("snp"), F.col("vec_id").alias("sample"), g.alias("g"))


def ev_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete users x days table ``(i user, j day, v)`` with NULL when absent; days
    count from the date of the first event to that of the last."""
    ev = table(spark, sf_dir, "events", "user_id", "ts", "value")
    span = ev.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"), F.max("user_id").alias("u")).first()
    n_days = (span["b"] - span["a"]).days + 1 if span["a"] else 0
    n_users = 0 if span["u"] is None else int(span["u"]) + 1
    day = F.datediff(F.to_date("ts"), F.lit(span["a"])).cast("long")
    sums = ev.groupBy(F.col("user_id").alias("i"), day.alias("j")).agg(F.round(F.sum("value"), 2).alias("v"))
    cells = spark.range(n_users * n_days).select(
        idiv(F.col("id"), F.lit(max(1, n_days))).alias("i"), (F.col("id") % F.lit(max(1, n_days))).alias("j")
    )
    return cells.join(sums, ["i", "j"], "left")
