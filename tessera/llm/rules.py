"""Quality rules: gradient-boosted trees over document statistics, flattened to arrays for vectorised scoring.

Statistics are whole-text counts.  The trees are fitted to ``labels.quality`` on a bounded sample of labelled
documents (``max_rows``, outside the held-out fold) by second-order boosting of the logistic loss over quantile bins.
Monotonic constraints hold more symbols, repeated lines and repeated windows to never raise the score.  The fitted
trees are stored as parallel arrays (feature, threshold, left, right, value), and scoring walks all rows of a batch one
level at a time.

Defined cases: null or empty text has no words and fails the base rule; without usable labels the trees are empty and
the base rule alone decides; repeated rows each get a row; null ids are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import distinct_rows, keep_rows, labelled_texts, map_texts, texts_of

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
RUN = 5
MAX_ROWS = 20_000
KEEP = 0.5

FEATURES = (
    "log_words",
    "word_length",
    "symbols",
    "dup_lines",
    "repeat_words",
    "upper",
    "digits",
    "punctuation",
    "distinct_words",
    "same_neighbours",
    "line_words",
)
# Never raises the score: -1; free: 0.
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0, -1, 0)

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_PUNCT = b".,;:!?'\"()-"
_CONTINUES = bytes(range(0x80, 0xC0))  # UTF-8 continuation bytes; every other byte begins a code point


def repeat_words(words: list[bytes], run: int = RUN) -> int:
    """Words inside windows of ``run`` words that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(run))))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, x in enumerate(windows) if often[x] > 1])
    edge[at] += 1
    edge[at + run] -= 1
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of the trees."""
    text = text or b""
    words = text.split()
    n = len(words)
    joined = text.translate(None, BLANKS)
    chars = len(joined.translate(None, _CONTINUES))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    repeat = repeat_words(words)
    share = lambda drop: (len(joined) - len(joined.translate(None, drop))) / max(1, chars)
    features = [
        math.log1p(n),
        chars / max(1, n),
        symbols / max(1, chars),
        dup / max(1, len(lines)),
        repeat / max(1, n),
        share(_UPPER),
        share(_DIGIT),
        share(_PUNCT),
        len(set(words)) / max(1, n),
        sum(a == b for a, b in zip(words, words[1:])) / max(1, n),
        n / max(1, len(lines)),
    ]
    return (n, chars, symbols, dup, repeat), features


@dataclass
class Trees:
    """Flattened trees: node arrays, the root of each tree, and the constant they start from."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``; a leaf is its own child, so every row takes ``depth`` steps."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[row, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    ridge: float = 1.0,
    least: float = 2.0,
    monotone: tuple[int, ...] = MONOTONE,
) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins, with monotonic constraints.

    A split is allowed only if its children's values stand in the constrained order; the children's subtrees are then
    bounded by the middle of the two values, so the whole tree is monotone in the feature.
    """
    columns: list[list[float]] = [[], [], [], [], []]
    roots: list[int] = []
    n = len(x)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 1 - 1e-3
    start = math.log(mean / (1 - mean))
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(n, start)

        def add(feature, threshold, value) -> int:
            k = len(columns[0])
            for c, v in zip(columns, (feature, threshold, k, k, value)):
                c.append(v)
            return k

        def grow(rows, g, h, level, low, high) -> int:
            value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                    gr, hr = gs - gl, hs - hl
                    vl, vr = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (gr, hr)))
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
                    good = (hl >= least) & (hr >= least) & (monotone[f] * (vr - vl) >= 0)
                    if good.any() and (top := float(np.where(good, gain, -1).max())) > best[0]:
                        k = int(np.where(good, gain, -1).argmax())
                        best = (top, (f, k, float(vl[k]), float(vr[k])))
            if best[1] is None:
                return add(0, 0.0, rate * value)
            f, k, vl, vr = best[1]
            node, middle = add(f, float(edges[f][k]), 0.0), (vl + vr) / 2
            sides = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            (a, b), (c, d) = sides.get(monotone[f], ((low, high), (low, high)))
            under = binned[rows, f] <= k
            columns[2][node] = grow(rows[under], g, h, level + 1, a, b)
            columns[3][node] = grow(rows[~under], g, h, level + 1, c, d)
            return node

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -math.inf, math.inf))
            margin += _value(columns, roots[-1], x, depth)
    types = (np.int64, float, np.int64, np.int64, float)
    arrays = [np.array(c or [0], t) for c, t in zip(columns, types)]
    return Trees(*arrays, np.array(roots, np.int64), start, depth)


def _value(columns, root, x, depth) -> np.ndarray:
    feature, threshold, left, right, value = (np.array(c) for c in columns)
    node, row = np.full(len(x), root), np.arange(len(x))
    for _ in range(depth):
        node = np.where(x[row, feature[node]] <= threshold[node], left[node], right[node])
    return value[node]


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Trees:
    """Trees fitted to the statistics of about ``max_rows`` labelled documents at most; only their features leave the tasks."""

    def measure(ids, hashes, ys, texts):
        return {"doc_id": ids, "text_hash": hashes, "y": ys, "x": [statistics(t)[1] for t in texts]}

    sample = labelled_texts(texts_of(docs, id_col, text_col), labels, max_rows)
    measured = map_texts(sample, "doc_id long, text_hash long, y int, x array<double>", measure)
    rows = distinct_rows(measured, ["x"]).select("y", "x").collect()
    rows.sort(key=lambda r: (r.y, r.x))  # the sum of floats must not depend on the order of partitions
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.array([r.y for r in rows], float))


def judge_texts(trees: Trees, texts: list[bytes | None], keep: float = KEEP) -> dict:
    """Columns of ``quality_rules`` but for the id."""
    found = [statistics(t) for t in texts]
    score = trees.score(np.array([f for _, f in found], float).reshape(len(found), len(FEATURES)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = {name: [c[k] for c, _ in found] for k, name in enumerate(names)}
    failed = [n < 10 or 100 * r > 20 * n for n, r in zip(out["n_words"], out["n_repeat_words"])]
    kept = [not f and s >= keep for f, s in zip(failed, score.tolist())]
    return out | {"base_failed": failed, "kept": kept, "score": score}


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    trees = docs.sparkSession.sparkContext.broadcast(fit_rules(docs, labels, id_col, text_col, max_rows))
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, score double"
    )
    return map_texts(
        texts_of(docs, id_col, text_col), schema, lambda ids, texts: {"doc_id": ids} | judge_texts(trees.value, texts, keep)
    )


def filter_rows(docs: DataFrame, labels: DataFrame, keep: float = KEEP, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns."""
    trees = docs.sparkSession.sparkContext.broadcast(fit_rules(docs, labels, max_rows=max_rows))
    return keep_rows(docs, lambda texts: judge_texts(trees.value, texts, keep)["kept"])
