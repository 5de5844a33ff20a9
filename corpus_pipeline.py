"""Corpus preparation in five stages, each one operator of ``tessera.llm`` over all that its predecessor kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  All but the last
return the columns of ``documents``.  ``run`` writes each stage as Parquet in the shared checkpoint folder and reads it back
for the next, so a lost executor never costs more than one stage.

Rows are judged by their own text, not by their id: an id with several texts may lose one and keep another, rows of a null id
are treated like any other, and of equal rows near-duplicate removal keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, packing, rules, simhash, spans
from tessera.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the trees keep."""
    return rules.filter_rows(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of its least id."""
    return simhash.filter_rows(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences covered by a repeated span that is not the first; n_chars follows the text."""
    return spans.filter_rows(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return decontam.filter_rows(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, every id of every remaining document in exactly one."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pack_sequences", pack_sequences),
]

# The stages hold trained trees, XXH64 fingerprints and a tokenizer, which SQL cannot express; a test holds the whole run
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
