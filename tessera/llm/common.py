"""Shared helpers of the text operators: per-document Arrow maps, scratch tables and label samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.core import drop_lineage, ensure_checkpoint_dir, ship_package, shuffle_partitions

# Rows that Spark hands to a Python worker at once, and bytes of text that a worker handles at once.
BATCH_ROWS = 1000
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id BIGINT, text BINARY)``: the two columns the operators need, the text as UTF-8 bytes."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"),
    )


def slices(batch: pa.RecordBatch, column: str | int = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``max_bytes`` of text; one long document stays whole."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // max_bytes
    cuts = np.append(np.flatnonzero(np.diff(part)) + 1, batch.num_rows)
    lo = 0
    for hi in cuts:
        yield batch.slice(lo, hi - lo)
        lo = hi


def limit_batches(spark: SparkSession) -> None:
    """Bound the rows per Arrow batch (long texts in 10,000-row batches would not fit a worker), and see that the
    workers have this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def map_texts(df: DataFrame, schema: str, fn: Callable[..., dict], column: str | None = "text") -> DataFrame:
    """``fn`` gets the columns of ``df`` as lists, a few MB of ``column`` at a time (None: a batch), and returns
    columns of ``schema``."""
    limit_batches(df.sparkSession)
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column) if column else [batch]:
                made = fn(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, kind)


def keep_rows(docs: DataFrame, judge: Callable[[list[bytes | None]], list[bool]], text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text ``judge`` keeps; nothing is shuffled."""
    limit_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = [None if t is None else t.encode() for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(judge(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, key_id, key_hash)``: the row as a struct, so that none of its names can clash, its id and its text's hash."""
    return docs.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.`{id_col}`").cast("long").alias("key_id"), F.xxhash64(F.col(f"row.`{text_col}`").cast("binary")).alias("key_hash")
    )


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind; else these lie on disk until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables in the shared checkpoint folder that cut a plan's lineage.

    Each table is written once and read back, so a lost executor costs no recomputation of what lies before it.
    ``drop`` deletes a table that later ones have replaced.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, ensure_checkpoint_dir(spark).rstrip("/")

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/tessera-llm-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        out._tessera_path = path
        return out

    def bucketed(self, df: DataFrame, column: str) -> DataFrame:
        """As ``cut``, in one bucket a shuffle partition: what is read back is partitioned as by a shuffle on ``column``,
        so that grouping by it, joining on it and co-grouping move no row.  The catalog's entry goes at once; the files stay."""
        name = f"tessera_llm_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        df.write.format("parquet").option("path", path).bucketBy(shuffle_partitions(self.spark), column).saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        out._tessera_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        drop_lineage(df)


def is_held_out(id_col: str = "doc_id"):
    """The fold that no model is trained on: crc32 of the id's text, mod 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_share(cols: list[str], wanted: int, total: int):
    """Keeps about ``wanted`` of ``total`` distinct values of ``cols``, the same ones on any layout; nothing is sorted or gathered."""
    steps = 1 << 31
    return F.pmod(F.xxhash64(*cols), F.lit(steps)) < min(steps, steps * wanted // max(1, total))


def labelled_texts(texts: DataFrame, labels: DataFrame, max_rows: int, target: str = "quality") -> DataFrame:
    """``(doc_id, text_hash, y, text)``: about ``max_rows`` labelled texts outside the held-out fold (all, if there are no
    more), chosen by the hash of id and text so that the sample does not depend on the layout.

    ``texts``: doc_id, text.  Rows are counted, not ids, so an id with very many rows stays in the bound; equal
    rows are one example, which the caller sees once for every copy (``distinct_rows``).  Null ids and labels are
    left out, repeated label ids keep their least label.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
    )
    hashed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    pairs = Scratch(texts.sparkSession).cut(hashed.select("doc_id", "text_hash").distinct().join(known, "doc_id"))
    chosen = pairs.filter(hash_share(["doc_id", "text_hash"], max_rows, pairs.count()))  # bounded, so it may be broadcast
    return hashed.join(F.broadcast(chosen), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "y", "text")


def distinct_rows(rows: DataFrame, values: list[str]) -> DataFrame:
    """One row for each (doc_id, text_hash, y): copies have the same ``values`` and are dropped before the shuffle."""
    return rows.groupBy("doc_id", "text_hash", "y").agg(*[F.first(c).alias(c) for c in values])
