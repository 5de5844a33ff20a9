"""Ranked lexical search: norm buckets of impact vectors, pruned by Cauchy-Schwarz and by coordinates, rescored in integers.

A query item is a vector of term weights, a document a vector of impacts over the items' terms, a score their inner
product.  The texts are read once, for the counts of the items' terms in every document; weights, impacts and
vector lengths follow from these counts in Spark.  The document vectors are ordered by length over the whole corpus (a
range partitioning, equal lengths spread by a hash) and written, so that a task reads them longest first.

* The longest ``HEAD`` vectors are searched first.  The ``k``-th best score among them is a lower bound of the item's
  ``k``-th best of all.
* Vectors that are too short for every item's bound are not read: Cauchy-Schwarz as a filter on the written lengths.
* A task cuts its vectors into buckets of similar length.  An item skips the vectors of a bucket whose length times its
  own falls short of its bound, and all later buckets when the first one does.
* Within a bucket the item's heaviest ``FOCUS`` coordinates bound what is left: their part of the product is exact, the
  rest is at most the product of the two remaining lengths.
* Survivors are scored in 64-bit integers, and the ``k`` best so far raise the bound.

Pruning compares doubles with a margin, so no score is lost to rounding.  Items come in blocks of at most
``block_bytes`` of text; a block is what is broadcast, and reads the documents once.

Defined cases: a null text has no terms, as has an empty one; items without terms, or whose terms no document has, return no
row; items of a null id are left out, rows of one item id are one item with the terms of all; repeated documents are ranked each;
documents of a null id count and rank like any other, after the named ones of equal score; empty tables give no row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, limit_batches, map_texts, texts_of

K = 50
BUCKET = 4096  # vectors of a bucket
BUCKET_ENTRIES = 1 << 20  # and their entries
FOCUS = 6
HEAD = 20_000
PARTITION_ENTRIES = 4 << 20  # entries of the vectors that a task searches
BLOCK_BYTES = 4 << 20
SCALE, SPAN, TERM, FIXED, SLOPE = 1_000_000_000, 1000, 20, 100, 50  # fixed values of the score
MARGIN = 1 + 1e-9
_LAST = np.iinfo(np.int64).max  # stands for a null id

# A-Z to a-z, every byte outside a term to a blank; bytes from 0x80 on belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, term array<int>, tf array<int>)``: a document's number of terms and its counts of the vocabulary's."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(ids, texts):
        number = known.value
        out: dict[str, list] = {"doc_id": ids, "n": [], "term": [], "tf": []}
        for text in texts:
            terms = terms_of(text)
            own = sorted((number[w], c) for w, c in Counter(terms).items() if w in number)
            out["n"].append(len(terms))
            out["term"].append([t for t, _ in own])
            out["tf"].append([c for _, c in own])
        return out

    return map_texts(texts_of(docs, id_col, text_col), "doc_id long, n long, term array<int>, tf array<int>", count)


def vectors(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``(doc_id, length, term, impact)`` of the documents that have an entry; all but the length is integer arithmetic."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    ratio = F.call_function("div", wide("n") * F.lit(n_docs * SLOPE).cast("decimal(20,0)"), F.lit(max(1, n_terms)).cast("decimal(20,0)"))
    m = F.lit(FIXED - SLOPE).cast("long") + ratio.cast("long")
    impact = F.transform("tf", lambda tf: F.call_function("div", F.lit(SCALE).cast("long") * tf, F.lit(SPAN).cast("long") * tf + F.lit(TERM).cast("long") * F.col("m")))
    square = F.aggregate("impact", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (
        counts.filter(F.size("term") > 0)
        .withColumn("m", m)
        .select("doc_id", "term", impact.alias("impact"))
        .select("doc_id", F.sqrt(square).alias("length"), "term", "impact")
    )


class Search:
    """The ``k`` best documents of each item of a block, among the vectors that one task feeds, longest first."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], n_vocabulary: int, bounds: np.ndarray, k: int, focus: int = FOCUS):
        """``items``: term numbers and weights, heaviest first; ``bounds``: a score that each item's ``k``-th best reaches."""
        self.items, self.k, self.focus = items, k, focus
        self.size = [math.sqrt(float((w.astype(float) ** 2).sum())) for _, w in items]
        self.bounds = bounds.astype(np.int64).copy()
        self.dense = np.zeros(n_vocabulary, np.int64)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        self.active = [q for q, (t, _) in enumerate(items) if len(t)]
        self.scored = 0

    def feed(self, ids: np.ndarray, length: np.ndarray, start: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """A bucket: ids, lengths (descending), and the entries of row ``r`` at ``start[r]:start[r + 1]``."""
        row = np.repeat(np.arange(len(ids)), np.diff(start))
        by_term = np.argsort(term, kind="stable")
        posting = (np.searchsorted(term[by_term], np.arange(len(self.dense) + 1)), row[by_term], impact[by_term])
        still = []
        for q in self.active:
            # Lengths descend from bucket to bucket: an item that the first vector fails is done.
            if length[0] * self.size[q] * MARGIN < self.bounds[q]:
                continue
            still.append(q)
            self._search(q, ids, length, start, term, impact, posting)
        self.active = still

    def _search(self, q, ids, length, start, term, impact, posting) -> None:
        (terms, weights), bound = self.items[q], self.bounds[q]
        rows = int(np.searchsorted(-length, -(bound / (self.size[q] * MARGIN)), side="right"))
        at, row, value = posting
        exact, square, left = np.zeros(rows), np.zeros(rows), self.size[q] ** 2
        for t, w in zip(terms[: self.focus].tolist(), weights[: self.focus].tolist()):
            a = at[t]
            b = a + np.searchsorted(row[a : at[t + 1]], rows)
            x = value[a:b].astype(float)
            exact[row[a:b]] += w * x
            square[row[a:b]] += x * x
            left -= float(w) * w
        rest = np.sqrt(max(0.0, left) * np.maximum(0.0, length[:rows] ** 2 * MARGIN - square))
        near = np.flatnonzero((exact + rest) * MARGIN >= bound)
        if not len(near):
            return
        self.scored += len(near)
        self.dense[terms] = weights
        n = start[near + 1] - start[near]
        first = np.cumsum(n) - n
        at = np.repeat(start[near] - first, n) + np.arange(int(n.sum()))
        score = np.add.reduceat(self.dense[term[at]] * impact[at], first)
        self.dense[terms] = 0
        keep = (score > 0) & (score >= bound)
        if not keep.any():
            return
        score, who = np.append(self.best[q][0], score[keep]), np.append(self.best[q][1], ids[near[keep]])
        top = np.lexsort((who, -score))[: self.k]
        self.best[q] = score[top], who[top]
        if len(top) == self.k:
            self.bounds[q] = max(bound, int(score[top[-1]]))


def search(rows: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_vocabulary: int, bounds: np.ndarray, k: int = K, focus: int = FOCUS) -> DataFrame:
    """``(q int, score long, doc_id long)``: each task's ``k`` best rows for each item; a task's rows are longest first."""
    limit_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((items, n_vocabulary, bounds, k, focus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Search(*shared.value)
        held: list[pa.RecordBatch] = []

        def feed() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, length, term, impact = (t.column(c).chunk(0) for c in ("doc_id", "length", "term", "impact"))
            order = np.argsort(-length.to_numpy(), kind="stable")  # a file's rows may follow another's
            if (np.diff(order) < 0).any():
                ids, length, term, impact = (x.take(pa.array(order)) for x in (ids, length, term, impact))
            start = np.append(0, np.cumsum(term.value_lengths().to_numpy())).astype(np.int64)
            find.feed(ids.fill_null(_LAST).to_numpy(), length.to_numpy(), start, term.flatten().to_numpy(), impact.flatten().to_numpy())
            held.clear()

        lowest, entries = math.inf, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            if length.max() > lowest:  # another file begins, so items that were done are not
                if held:
                    feed()
                    entries = 0
                find.active = [q for q, (t, _) in enumerate(items) if len(t)]
            lowest = length.min()
            if not find.active:
                continue
            held.append(batch)
            entries += len(batch.column("term").flatten())
            if sum(b.num_rows for b in held) >= BUCKET or entries >= BUCKET_ENTRIES:
                feed()
                entries = 0
        if held:
            feed()
        q = np.repeat(np.arange(len(items), dtype=np.int32), [len(s) for s, _ in find.best])
        score, who = (np.concatenate([b[x] for b in find.best]) if find.best else np.empty(0, np.int64) for x in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score), pa.array(who, mask=who == _LAST)], names=["q", "score", "doc_id"])

    return rows.mapInArrow(run, "q int, score long, doc_id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, item_terms: list[set[bytes]], id_col: str, text_col: str, k: int, head: int, scratch: Scratch) -> DataFrame:
    """``(q, rank, doc_id, score)`` for the items of one block."""
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*item_terms)))}
    counts = scratch.cut(counted(docs, vocabulary, id_col, text_col))
    total = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("term")).alias("entries")).first()
    n_docs, n_terms, entries = (x or 0 for x in total)
    df = dict(counts.select(F.explode("term").alias("t")).groupBy("t").count().collect())  # at most the vocabulary
    items = []
    for words in item_terms:
        heavy = sorted(((weight(n_docs, df[t]), t) for t in (vocabulary[w] for w in words) if t in df), reverse=True)
        heavy = [(w, t) for w, t in heavy if w > 0]
        items.append((np.array([t for _, t in heavy], np.int64), np.array([w for w, _ in heavy], np.int64)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries / PARTITION_ENTRIES))
    ordered = vectors(counts, n_docs, n_terms).withColumn("spread", F.xxhash64("doc_id", "term"))
    ordered = ordered.repartitionByRange(parts, F.col("length").desc(), "spread").sortWithinPartitions(F.col("length").desc(), "spread").drop("spread")
    ordered = scratch.cut(ordered)
    scratch.drop(counts)

    none = np.ones(len(items), np.int64)
    cut = _length_of_rank(ordered, head)
    first = _ranked(search(ordered.filter(F.col("length") >= cut), items, len(vocabulary), none, k), k)
    bounds = none.copy()
    for row in first.filter(F.col("rank") == k).select("q", "score").collect():  # a row an item
        bounds[row.q] = row.score
    size = [math.sqrt(float((w.astype(float) ** 2).sum())) for _, w in items]
    least = min((b / (s * MARGIN) for b, s in zip(bounds, size) if s), default=math.inf)
    return _ranked(search(ordered.filter(F.col("length") >= least), items, len(vocabulary), bounds, k), k)


def _length_of_rank(ordered: DataFrame, head: int) -> float:
    """A length that at least ``head`` vectors reach (or all), from a histogram of lengths in steps of 1/16 of an octave."""
    step = F.floor(F.log2("length") * 16).cast("int")
    seen = 0
    for row in sorted(ordered.groupBy(step.alias("s")).count().collect(), reverse=True):  # lengths are doubles of 16 octaves or so
        seen += row["count"]
        if seen >= head:
            return 2.0 ** (row.s / 16)
    return 0.0


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = K,
    head: int = HEAD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each item its ``k`` documents of highest score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").cast("binary").alias("text")).filter("item_id is not null")
    kind = asked.schema["item_id"].dataType
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", kind)])
    scratch = Scratch(spark)
    out: DataFrame | None = None
    for block in range(blocks):
        terms: dict = {}
        for row in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            terms.setdefault(row.item_id, set()).update(terms_of(row.text and bytes(row.text)))
        ids = sorted(terms)
        found = _block(docs, [terms[i] for i in ids], id_col, text_col, k, head, scratch)
        named = F.broadcast(spark.createDataFrame(list(enumerate(ids)), schema))
        found = found.join(named, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(scratch.cut(found))
    return out
