"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are word unigrams and bigrams hashed to ``2**bits`` weights; words and runs of punctuation are separate
tokens, a token equal to its predecessor becomes one fixed token, and an n-gram seen before in the same text adds one
fixed n-gram, so repetition has weights of its own.  A document's value at a weight is its count there times
``SCALE / n_grams``, so the score is a sparse dot product that does not grow with the text's length.

Training takes about ``max_rows`` labelled rows at most (chosen by the hash of id and text, outside the held-out fold; equal rows
are one), dealt to ``shards`` groups by hash.  What is dealt are a text's hashed features (at most ``2**bits``), never the text.
Each group trains a per-coordinate FTRL-proximal model over ``epochs`` passes in its own task; the model is the mean
of the groups' weights.

Defined cases: null and empty texts have no feature and get the score of the bias; without usable labels every score is
0.5; repeated rows each get a row; null ids are kept and are not held out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_rows, is_held_out, labelled_texts, limit_batches, map_texts, texts_of

BITS = 18
MAX_ROWS = 16_000
SHARDS = 4
SCALE = 20.0
THRESHOLD = 0.7

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
_SAME, _AGAIN = 0x5A4E, 0xA6A1  # stand for a repeated token and for a repeated n-gram


def gram_indices(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Weight index of each unigram and bigram of the text, repeats included."""
    tokens = _TOKEN.findall(text) if text else []
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    same = np.flatnonzero(h[1:] == h[:-1]) + 1
    h[same] = _SAME
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
    repeats = len(pairs) - len(np.unique(pairs))
    grams = np.concatenate([h, pairs, np.full(repeats, _AGAIN, np.uint64)])
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def dot(weights: np.ndarray, bias: float, index: np.ndarray) -> float:
    return bias + (SCALE * float(weights[index].sum()) / len(index) if len(index) else 0.0)


def features(text: bytes | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weight indices of a text, ascending, and its value at each."""
    index = gram_indices(text, bits)
    at, count = np.unique(index, return_counts=True)
    return at, count * (SCALE / max(1, len(index)))


def train(
    examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 3, bits: int = BITS, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5
) -> np.ndarray:
    """FTRL-proximal over (label, indices, values): per coordinate a sum of adjusted gradients ``z`` and of squares ``n``; the
    bias is the last weight."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    weigh = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    rows = [(y, np.append(at, size), np.append(x, 1.0)) for y, at, x in examples]
    for _ in range(epochs):
        for y, at, x in rows:
            w = weigh(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weigh(z, n)


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, shards: int = SHARDS
) -> np.ndarray:
    """Weights (the bias last): the mean of the models of ``shards`` groups of the labelled sample."""
    limit_batches(docs.sparkSession)

    def hashed(ids, hashes, ys, texts):
        found = [features(t) for t in texts]
        return {"doc_id": ids, "text_hash": hashes, "y": ys, "at": [a.astype(np.int32) for a, _ in found], "x": [x for _, x in found]}

    sample = labelled_texts(texts_of(docs, id_col, text_col), labels, max_rows)
    rows = map_texts(sample, "doc_id long, text_hash long, y int, at array<int>, x array<double>", hashed)
    rows = distinct_rows(rows.withColumn("f", F.struct("at", "x")), ["f"])
    order = F.xxhash64("doc_id", "text_hash")
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), order.alias("place"), "y", "f.at", "f.x")

    def fit(group):
        import pandas as pd

        group = group.sort_values(["place", "y"])
        w = train([(int(y), np.asarray(at, np.int64), np.asarray(x, float)) for y, at, x in zip(group.y, group["at"], group.x)])
        return pd.DataFrame({"rows": [len(group)], "w": [w.astype(np.float32).tobytes()]})

    models = rows.groupBy("shard").applyInPandas(fit, "rows long, w binary").collect()
    if not models:
        return np.zeros((1 << BITS) + 1)
    models.sort(key=lambda m: bytes(m.w))  # the sum of floats must not depend on the order of tasks
    return sum(np.frombuffer(m.w, np.float32).astype(float) * m.rows for m in models) / sum(m.rows for m in models)


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Per document row: doc_id, held_out, score (probability of label 1), predicted (1 if score >= threshold)."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, id_col, text_col, max_rows))

    def score(ids, held, texts):
        w = model.value
        logit = np.array([dot(w, w[-1], gram_indices(t)) for t in texts])
        p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
        return {"doc_id": ids, "held_out": held, "score": p, "predicted": (p >= threshold).astype(np.int32)}

    rows = texts_of(docs, id_col, text_col).select("doc_id", is_held_out().alias("held_out"), "text")
    return map_texts(rows, "doc_id long, held_out boolean, score double, predicted int", score)
