"""Substring de-duplication by sliding sentence spans.

A text is cut into sentences (after ``.``, ``!`` or ``?`` before white space, and at line ends).  Every run of two to ``RUN``
consecutive sentences with at least ``MIN_WORDS`` words is hashed, and every sentence that has ``LONG_WORDS`` words alone.
A global join on the hash finds, for every run, its first occurrence by (doc_id, position); sentences covered by any
occurrence that is not the first are removed, wherever they stand.

Most runs occur once.  A first pass marks the hashes that occur more than once in a bitmap of fixed size
(:mod:`tessera.llm.repeats`), and only runs with a mark become rows of the join.  Of those, only the least occurrence of a hash
within a task's slice of text has to be compared with the others; later ones in the same slice are known to be repeats.
A run that a third of all documents share therefore costs one joined row per slice.

Defined cases: null and empty texts have no sentence and come back as the empty text; repeated rows (equal id and text) are
one document -- each row gets the same result; rows of a null id come first in the order; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Scratch, keyed, limit_batches, map_texts, slices, texts_of
from .repeats import bucket_bits, find_repeats

RUN = 3
MIN_WORDS = 10
LONG_WORDS = 25

_END = re.compile(rb"(?<=[.!?])[ \t\r\f\v]+|\n\s*")


def sentences(text: bytes | None) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normalised words, number of words) of each sentence; the end includes the blanks after it."""
    out, at = [], 0
    text = text or b""
    for m in _END.finditer(text):
        if words := text[at : m.start()].split():
            out.append((at, m.end(), b" ".join(words).lower(), len(words)))
            at = m.end()
    if words := text[at:].split():
        out.append((at, len(text), b" ".join(words).lower(), len(words)))
    return out


def runs(parts: list[tuple[int, int, bytes, int]]) -> list[tuple[int, int, int]]:
    """(hash, first sentence, number of sentences) of every run that is looked up."""
    found = []
    for i in range(len(parts)):
        words = 0
        for size in range(1, RUN + 1):
            if i + size > len(parts):
                break
            words += parts[i + size - 1][3]
            if words >= (MIN_WORDS if size > 1 else LONG_WORDS):
                key = xxhash.xxh64_intdigest(b"\n".join([p[2] for p in parts[i : i + size]]), size)
                found.append((key - (1 << 63), i, size))
    return found


def repeated_sentences(texts: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, covered)``: for each document the sentences (flat array of first and number) covered by runs
    that occurred before.  ``texts``: doc_id, text."""
    spark = texts.sparkSession
    limit_batches(spark)

    def keys_of(batch: pa.RecordBatch):
        for part in slices(batch):
            found = [key for text in part.column(0).to_pylist() for key, _, _ in runs(sentences(text))]
            key = np.array(found, np.int64).view(np.uint64)
            yield key, np.zeros(len(key), np.uint32), np.arange(len(key))  # any two runs count, also of one document

    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    repeats = spark.sparkContext.broadcast(find_repeats(texts.select("text"), keys_of, bucket_bits(total // 40))[0])

    def emit(ids, hashes, texts):
        rows, seen = [], {}
        for doc_id, text_hash, text in zip(ids, hashes, texts):
            for key, i, size in runs(sentences(text)):
                rows.append((key, doc_id, text_hash, i, size))
        marked = repeats.value.is_repeated(np.array([r[0] for r in rows], np.int64).view(np.uint64))
        rows = [r for r, m in zip(rows, marked.tolist()) if m]
        rows = list(dict.fromkeys(rows))  # an equal row has the same places, none of which repeats another
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        local = [seen.setdefault(r[0], r) is not r for r in rows]
        names = ("key", "doc_id", "text_hash", "at", "size")
        return {n: [x[k] for x in rows] for k, n in enumerate(names)} | {"local": local}

    scratch = Scratch(spark)
    hashed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = scratch.cut(map_texts(hashed, "key long, doc_id long, text_hash long, at int, size int, local boolean", emit))
    known = found.filter("local").select("doc_id", "text_hash", "at", "size")
    place = F.struct("doc_id", "text_hash", "at")
    heads = found.filter("not local")
    first = heads.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = heads.join(first, "key").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "at", "size")
    return (
        known.unionByName(later)
        .groupBy("doc_id", "text_hash")
        .agg(F.flatten(F.collect_set(F.array("at", "size"))).alias("covered"))  # at most three runs a sentence of one text
    )


def cut_text(text: bytes | None, covered: list[int] | None) -> tuple[bytes, int, int]:
    """(what is kept, sentences, sentences removed)."""
    parts = sentences(text)
    drop = np.zeros(len(parts), bool)
    for at, size in zip((covered or [])[0::2], (covered or [])[1::2]):
        drop[at : at + size] = True
    if not drop.any():
        return text or b"", len(parts), 0
    return b"".join(text[p[0] : p[1]] for p, d in zip(parts, drop) if not d).rstrip(), len(parts), int(drop.sum())


def _with_covered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, covered)`` for each row of ``docs``."""
    covered = repeated_sentences(texts_of(docs, id_col, text_col)).withColumnsRenamed({"doc_id": "c_id", "text_hash": "c_hash"})
    same = F.col("key_id").eqNullSafe(F.col("c_id")) & (F.col("key_hash") == F.col("c_hash"))
    return keyed(docs, id_col, text_col).join(covered, same, "left").select("row", "covered")


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, text (what is kept), n_sentences, n_removed."""

    def cut(ids, texts, covered):
        made = [cut_text(t, c) for t, c in zip(texts, covered)]
        columns = {"text": [m[0].decode("utf-8", "replace") for m in made], "n_sentences": [m[1] for m in made]}
        return {"doc_id": ids, "n_removed": [m[2] for m in made]} | columns

    rows = _with_covered(texts_of(docs, id_col, text_col), "doc_id", "text").select("row.doc_id", "row.text", "covered")
    return map_texts(rows, "doc_id long, text string, n_sentences long, n_removed long", cut)


def filter_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, their texts without repeated spans; n_chars, if there, follows the text.
    Rows of which nothing is left go."""
    names = docs.columns
    rows = _with_covered(docs, "doc_id", "text")
    limit_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kept = batch.column(0), []
            for text, covered in zip(row.field("text").to_pylist(), batch.column(1).to_pylist()):
                left, _, removed = cut_text(text.encode(), covered) if covered and text else (b"", 0, 0)
                kept.append(left.decode("utf-8", "replace") if removed else None)
            yield pa.RecordBatch.from_arrays([row, pa.array(kept, pa.string())], names=["row", "kept"])

    kept = rows.mapInArrow(cut, StructType([rows.schema["row"], StructField("kept", StringType())]))
    changed = F.col("kept").isNotNull()
    made = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in names:
        made["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return kept.filter(~changed | (F.length("kept") > 0)).select(*[made.get(n, F.col(f"row.`{n}`")).alias(n) for n in names])
