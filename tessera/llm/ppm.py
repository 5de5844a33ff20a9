"""Prediction by partial matching: log probabilities of whole texts under a byte-context trie of the training corpus.

The model codes a text's lower-cased words, joined by blanks, byte by byte, and then an end.  A symbol's context is the
``ORDER`` bytes before it (ends before the first byte).  Level ``j`` of the trie is a table of the contexts of ``j`` bytes
with the symbols that follow them and their counts.  A symbol is coded at the longest context that has it; every context
that lacks it costs an escape (method C: a context's distinct symbols against its count), and symbols of the longer context are
excluded from the counts of the shorter one.  What no context has is uniform over the bytes left.

All steps are distributed, and nothing that grows with the corpus is broadcast or reaches the driver:

* Documents are written in *slices* of at most ``slice_bytes`` (a longer text is a slice of its own).  One pass sends every
  slice's distinct windows (context and symbol as one integer) and words with their counts in training documents; they
  are shuffled once, to a bucketed table, which is summed and joined in place.
* Summed, these are the deepest level of the trie and the word counts; each shorter level is a sum over the one below.  A
  context has at most 256 symbols and at most 256 contexts one byte longer, so no join or group of the model has a hot key.
* A window that training text has costs its count against its context's.  The others, met in held-out text only, walk up
  the levels as distinct windows until a context has their symbol, and the costs of the escapes are added on the way back.
* Costs and counts return to the slices that asked, and every slice scores its documents.

Base: the words' add-one unigram model.  Defined cases: a null text is empty; a text without words is its end alone; a null id
is not held out and is learned from; repeated rows each count and get a row; with no training document every symbol is uniform
over 256 values and the base score is 0; an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.core import shuffle_partitions

from .common import Scratch, limit_batches, shuffles_dropped, texts_of

ORDER = 5  # bytes of context; a window of one byte more has to fit 63 bits
SLICE_BYTES = 16 << 20
PIECE_BYTES = 1 << 20  # whose windows are handled at once
WORDS_BYTES = 4 << 20  # whose words are
MOST_KEYS = 2_000_000  # distinct windows that a worker gathers before it sends them
MOST_WORDS = 300_000
SENT_ROWS = 100_000
END = b"\n"  # no word has it
SYMBOLS = 256

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, mod 7, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of every byte and of the end of every text as integers, in order, and where each text's begin."""
    joined = b"".join(END * order + t + END for t in texts) + bytes(8)
    at = np.cumsum([0, *(len(t) + 1 + order for t in texts)])
    words = np.ndarray(int(at[-1]), ">u8", joined, strides=(1,))
    keys = words.astype(np.uint64) >> np.uint64(8 * (7 - order))
    inside = np.ones(len(keys), bool)
    inside[(at[1:, None] - 1 - np.arange(order)).ravel()] = False  # windows that reach into the next text
    return keys[inside].astype(np.int64), at[:-1] - order * np.arange(len(texts))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.diff(np.append(first, len(keys)))


def _merged(keys: np.ndarray, n: np.ndarray, more: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of distinct, ascending keys as one; the counts of a key in both add up."""
    at = np.searchsorted(keys, more)
    old = at < len(keys)
    old[old] = keys[at[old]] == more[old]
    n = n.copy()
    n[at[old]] += m[old]
    return np.insert(keys, at[~old], more[~old]), np.insert(n, at[~old], m[~old])


def sliced(docs: DataFrame, id_col: str, text_col: str, slice_bytes: int) -> DataFrame:
    """``(slice, doc_id, held_out, text)``: the words of each text, in slices that are named by their first row."""
    limit_batches(docs.sparkSession)
    rows = texts_of(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("slice"), "doc_id", is_held_out().alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size = None, 0
        for batch in batches:
            row, *rest, texts = (c.to_pylist() for c in batch.columns)
            texts = [b" ".join(words_of(t)) for t in texts]
            names = []
            for r, t in zip(row, texts):
                if name is None or size + len(t) > slice_bytes:
                    name, size = r, 0
                size += len(t) + 1
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *batch.columns[1:3], pa.array(texts, pa.binary())], names=["slice", "doc_id", "held_out", "text"])

    return rows.mapInArrow(run, "slice long, doc_id long, held_out boolean, text binary")


def gathered(slices: DataFrame, order: int) -> DataFrame:
    """``(slice, word, key, n)``: each slice's distinct windows (``word`` null, ``key`` the window) and words (``END`` for a text's
    end; ``key`` a hash), with their occurrences in training documents.  A slice in two tasks, or with very many of either,
    sends some of them twice."""
    limit_batches(slices.sparkSession)
    schema = pa.schema([("slice", pa.int64()), ("word", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, keys, counts = None, np.empty(0, np.int64), np.empty(0, np.int64)
        words: Counter[bytes] = Counter()

        def send_keys() -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts
            for a in range(0, len(keys), SENT_ROWS):
                k, n = pa.array(keys[a : a + SENT_ROWS]), pa.array(counts[a : a + SENT_ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), name)), pa.nulls(len(k), pa.binary()), k, n], schema=schema)
            keys = counts = np.empty(0, np.int64)

        def send_words() -> Iterator[pa.RecordBatch]:
            found = list(words.items())
            for a in range(0, len(found), SENT_ROWS):
                w, n = zip(*found[a : a + SENT_ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), name)), pa.array(w, pa.binary()), pa.nulls(len(w), pa.int64()), pa.array(n, pa.int64())], schema=schema)
            words.clear()

        for batch in batches:
            for now, held, texts in _pieces(batch):
                if now != name:
                    yield from send_keys()
                    yield from send_words()
                    name = now
                for texts, learned in ((held, 0), (texts, 1)):
                    for lo, hi in _bounds(list(map(len, texts)), PIECE_BYTES):
                        k, n = _distinct(windows(texts[lo:hi], order)[0])
                        keys, counts = _merged(keys, counts, k, n * learned)
                        if len(keys) > MOST_KEYS:
                            yield from send_keys()
                    for t in texts:
                        own = [*t.split(), END]
                        if learned:
                            words.update(own)
                        else:
                            words.update(dict.fromkeys(own, 0))
                        if len(words) > MOST_WORDS:
                            yield from send_words()
        yield from send_keys()
        yield from send_words()

    found = slices.select("slice", "held_out", "text").mapInArrow(run, "slice long, word binary, key long, n long")
    return found.withColumn("key", F.coalesce("key", F.xxhash64("word")))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """Slice, held-out texts and training texts of each run of rows of one slice."""
    names = batch.column(0).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            part = batch.slice(a, b - a)
            held = part.column(1)
            texts = part.column(2)
            yield int(names[a]), texts.filter(held).to_pylist(), texts.filter(pc.invert(held)).to_pylist()


def _bounds(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes."""
    size, lo = 0, 0
    for k, n in enumerate(sizes):
        size += n + 1
        if size >= most or k + 1 == len(sizes):
            yield lo, k + 1
            size, lo = 0, k + 1


# --- the trie as tables ------------------------------------------------------------------------------------------------


def _shorter(key: str, level: int) -> Column:
    """The window of ``level`` bytes of context at the end of a longer one."""
    return F.col(key).bitwiseAND(F.lit((1 << 8 * (level + 1)) - 1))


def _context(key: str = "key") -> Column:
    return F.shiftright(key, 8)


def code_lengths(counted: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """``(key, cost)``: log10 probability of the symbol of each window after its context.  ``counted``: key and ``c``, the
    window's occurrences in training text (0: only met elsewhere)."""
    level = {order: counted.filter("c > 0")}
    for j in range(order - 1, -1, -1):
        level[j] = scratch.cut(level[j + 1].groupBy(_shorter("key", j).alias("key")).agg(F.sum("c").alias("c")))

    def contexts(j: int) -> DataFrame:
        """``(ctx, n, q, x)``: count, distinct symbols, and the count of these symbols in the context one byte shorter."""
        above = level[j - 1].select(F.col("key").alias("up"), F.col("c").alias("cu"))
        both = level[j].withColumn("up", _shorter("key", j - 1)).join(above, "up")
        return both.groupBy(_context().alias("ctx")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("q"), F.sum("cu").alias("x"))

    # Downwards in length: the windows that no level so far has, with their count at this level.
    asked = {}
    unseen = counted.filter("c = 0").select("key")
    for j in range(order, -1, -1):
        asked[j] = scratch.cut(unseen.join(level[j], "key", "left"))
        unseen = asked[j].filter("c is null").select(_shorter("key", j - 1).alias("key")).distinct()

    # Back up: ``r``, the cost of a symbol that the context lacks, once its escape is paid.
    root = level[0].agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("q")).first()
    n0, q0 = (F.lit(x).cast("long") for x in root)
    found = asked[0].select("key", "c", n0.alias("n"), q0.alias("q"), F.when(F.col("c").isNull(), -F.log10(F.lit(float(max(1, SYMBOLS - root.q))))).alias("r"))
    for j in range(1, order + 1):
        up = found.select(F.col("key").alias("up"), *[F.col(x).alias(f"{x}_up") for x in ("c", "n", "q", "r")])
        here = asked[j].withColumns({"up": _shorter("key", j - 1), "ctx": _context()})
        here = here.join(contexts(j), "ctx", "left").fillna(0, ["n", "q", "x"]).join(up, "up", "left")
        left = F.col("n_up") - F.col("x") + F.col("q_up") - F.col("q")  # without the excluded symbols
        escape = F.when(left > 0, F.log10(F.col("q_up") - F.col("q")) - F.log10(left)).otherwise(F.lit(0.0))
        r = F.when(F.col("c_up").isNotNull(), F.log10("c_up") - F.log10(left)).otherwise(escape + F.col("r_up"))
        found = scratch.cut(here.select("key", "c", "n", "q", F.when(F.col("c").isNull(), r).alias("r")))
    escape = F.when(F.col("n") > 0, F.log10("q") - F.log10(F.col("n") + F.col("q"))).otherwise(F.lit(0.0))
    unseen = found.select("key", (escape + F.col("r")).alias("cost"))
    seen = level[order].withColumn("ctx", _context()).join(contexts(order), "ctx")
    return seen.select("key", (F.log10("c") - F.log10(F.col("n") + F.col("q"))).alias("cost")).unionByName(unseen)


# --- scores --------------------------------------------------------------------------------------------------------------


class Costs:
    """Costs of sorted windows by a table of places; the few windows that share a place are searched for."""

    def __init__(self, keys: np.ndarray, cost: np.ndarray):
        self.keys, self.cost = keys, cost
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        self.place = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.place[self._at(keys)] = np.arange(len(keys), dtype=np.int32)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place[self._at(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return self.cost[at]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per document row: ``RESULT``."""
    if not 1 <= order <= 6:
        raise ValueError("a window of order + 1 bytes has to fit a long")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    with shuffles_dropped(spark):
        slices = scratch.bucketed(sliced(docs, id_col, text_col, slice_bytes), "slice")
        sent = scratch.bucketed(gathered(slices, order).repartition(shuffle_partitions(spark), "key"), "key")
        key_rows, word_rows = sent.filter("word is null"), sent.filter("word is not null")
        counted = scratch.cut(key_rows.groupBy("key").agg(F.sum("n").alias("c")))
        words = word_rows.groupBy("key", "word").agg(F.sum("n").alias("c"))
        total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
        cost = scratch.cut(code_lengths(counted, order, scratch))
    train_tokens, base_total = total.n, np.log10(total.n + total.v + 1)

    known = F.sum("n").over(Window.partitionBy("key", "word"))  # a slice has a word once or a few times
    hashed = word_rows.select("slice", "word", known.cast("double").alias("cost")).withColumn("key", F.lit(None).cast("long"))
    answers = hashed.unionByName(
        key_rows.select("slice", "word", "key").join(cost, "key").select("slice", "word", "key", "cost")
    )

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        is_word = told.column("word").is_valid()
        asked, rest = told.filter(pc.invert(is_word)), told.filter(is_word)
        del told
        keys, first = np.unique(asked.column("key").to_numpy(), return_index=True)
        model = Costs(keys, asked.column("cost").to_numpy()[first])
        vocabulary, count = rest.column("word").combine_chunks(), rest.column("cost").to_numpy()
        del asked, rest
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for lo, hi in _bounds(pc.binary_length(texts.column("text")).to_pylist(), WORDS_BYTES):
            rows = texts.column("text").slice(lo, hi - lo).to_pylist()
            for c, d in _bounds(list(map(len, rows)), PIECE_BYTES):
                at, start = windows(rows[c:d], order)
                out["score"] += np.add.reduceat(model[at], start).tolist()
                del at
            own = [[*t.split(), END] for t in rows]
            first = np.cumsum([0, *map(len, own[:-1])])
            c = count[pc.index_in(pa.array([w for x in own for w in x], pa.binary()), value_set=vocabulary).to_numpy()]
            out["n_tokens"] += map(len, own)
            out["n_known"] += np.add.reduceat((c > 0).astype(np.int64), first).tolist()
            logs = np.log10(c + 1)
            out["base_score"] += [float(x - len(w) * base_total) for x, w in zip(np.add.reduceat(logs, first), own)]
        rows = texts.num_rows
        pa.default_memory_pool().release_unused()
        columns = {"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), **out, "train_tokens": pa.array([train_tokens] * rows, pa.int64())}
        return pa.table({n: columns[n] for n in (x.split()[0] for x in RESULT.split(", "))})

    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, RESULT)
