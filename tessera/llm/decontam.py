"""Benchmark decontamination: prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of a benchmark item (an item with fewer words is one window).  The
words of a window are ordered by rarity over *all* documents; a document can contain the window only if it
contains the window's rarest word, so that word is the only one joined (the necessary prefix of a containment
join with threshold 1).  A candidate must then pass the positional bounds (the window has to fit before and
after the joined word) and is verified word by word.

The join's build side is the item side.  It is handled in blocks of at most ``block_bytes`` of item text, so what is
broadcast has a bound however large the benchmark is; documents stream through the blocks without a shuffle.

Defined cases: a null text has no words; an empty benchmark hits nothing; an item without words has no window; items
with a null id are left out; rows of the same item id count as one item; repeated document rows each get a row.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, map_texts, texts_of

WINDOW = 13
BLOCK_BYTES = 8 << 20

# A-Z to a-z, every byte outside a word to a blank; bytes from 0x80 on belong to words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def count_words(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences over all documents of each word of ``vocabulary`` (bounded by the block it comes from)."""
    words = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def tally(texts):
        known, n = words.value, Counter()
        for t in texts:
            n.update(filter(known.__contains__, words_of(t)))
        return {"word": list(n), "n": list(n.values())}

    counted = map_texts(docs, "word binary, n long", tally).groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


def rarest_positions(items: list[list[bytes]], count: dict[bytes, int], window: int) -> dict[bytes, list[tuple[int, int]]]:
    """For each window the position of its rarest word: word -> (item, position), each pair once.  Of an item's equal windows
    the first is enough, so an item that repeats itself has few positions."""
    found: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
    for k, words in enumerate(items):
        rank = [(count.get(w, 0), w) for w in words]
        seen: set[tuple[bytes, ...]] = set()
        for s in range(max(1, len(words) - window + 1) if words else 0):
            own = tuple(words[s : s + window])
            if own in seen:
                continue
            seen.add(own)
            p = min(range(s, min(len(words), s + window)), key=lambda i: (rank[i], i))
            found[words[p]].add((k, p))
    return {w: sorted(at) for w, at in found.items()}


def scan(words: list[bytes], items: list[list[bytes]], index: dict[bytes, list[tuple[int, int]]], window: int):
    """Maximal runs of document words inside item windows as (first, last), and the items that hit.  What is kept is a mark a
    word, however many windows cover it."""
    change, hit = array("q"), set()
    n = len(words)
    for i, word in enumerate(words):
        at = index.get(word)
        if at is None:
            continue
        for k, p in at:
            item = items[k]
            size = min(window, len(item))
            left, most = 0, min(i, p, size - 1)
            while left < most and words[i - left - 1] == item[p - left - 1]:
                left += 1
            right, most = 0, min(n - 1 - i, len(item) - 1 - p, size - 1)
            if left + 1 + most < size:
                continue
            while right < most and words[i + right + 1] == item[p + right + 1]:
                right += 1
            if left + 1 + right >= size:
                if not change:
                    change.extend([0] * (n + 1))
                change[i - left] += 1
                change[i + right + 1] -= 1
                hit.add(k)
    if not change:
        return [], hit
    covered = np.cumsum(np.array(change)) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered[:-1], [False]]).astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edges[0::2], edges[1::2])], hit


def hit_words(runs: list[tuple[int, int]], n: int) -> int:
    """Words covered by the runs, of ``n`` words."""
    hit = np.zeros(n, bool)
    for a, b in runs:
        hit[a : b + 1] = True
    return int(hit.sum())


def judge(doc_ids, hashes, texts, runs, items) -> dict:
    """Columns of ``JUDGED`` from the flat runs and item ids of each document."""
    n = [len(words_of(t)) for t in texts]
    n_hit = [hit_words(list(zip(r[0::2], r[1::2])), k) if r else 0 for r, k in zip(runs, n)]
    return {
        "doc_id": doc_ids,
        "text_hash": hashes,
        "n_words": n,
        "n_hit": n_hit,
        "n_items": [len(x) for x in items],
        "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items],
        "contaminated": [h > 0 and 20 * h >= k for h, k in zip(n_hit, n)],
        "hit_runs": runs,
        "items": items,
    }


FOUND = "doc_id long, text_hash long, text binary, hit_runs array<int>, items array<string>"
JUDGED = (
    "doc_id long, text_hash long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "hit_runs array<int>, items array<string>"
)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document row: the columns of ``JUDGED``.  ``hit_runs`` are the runs [first, last] of words inside item windows,
    flat; ``items`` the ids (as strings) of the items whose windows occur."""
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    items = (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
        .filter("item_id is not null and text is not null")
        .distinct()
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = texts.withColumns({"hit_runs": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        ids, words = [r.item_id for r in rows], [words_of(bytes(r.text)) for r in rows]
        count = count_words(texts.select("text"), {w for x in words for w in x})
        block = spark.sparkContext.broadcast((ids, words, rarest_positions(words, count, window)))

        def find(doc_ids, hashes, texts, runs, hits, block=block, last=k == blocks - 1):
            item_ids, item_words, index = block.value
            found = [scan(words_of(t), item_words, index, window) for t in texts]
            runs = [[*r, *(x for run in f for x in run)] for r, (f, _) in zip(runs, found)]
            hits = [sorted({*h, *(item_ids[x] for x in g)}) for h, (_, g) in zip(hits, found)]
            if last:
                return judge(doc_ids, hashes, texts, runs, hits)
            return {"doc_id": doc_ids, "text_hash": hashes, "text": texts, "hit_runs": runs, "items": hits}

        out = map_texts(out, JUDGED if k == blocks - 1 else FOUND, find)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least one hit word, and at
    least a twentieth of all words hit)."""
    return contamination(docs, benchmark, id_col, text_col, **options).drop("text_hash", "hit_runs", "items")


def filter_rows(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, **options).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    same = F.col("key_id").eqNullSafe(F.col("bad_id")) & (F.col("key_hash") == F.col("bad_hash"))
    return keyed(docs).join(bad.distinct(), same, "left_anti").select("row.*")
