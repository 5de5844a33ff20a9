"""Order-preserving packing by dynamic programming over document and sentence boundaries.

Documents are packed in the order of their input partition, in groups of about ``GROUP`` tokens.  The stream of a group may
be cut at the end of a document (free), at the end of a sentence (``SENTENCE`` padding tokens' worth) or, within a sentence
longer than ``STRIDE`` tokens, at multiples of ``STRIDE`` (``INSIDE``).  ``best[j] = min(best[i] + padding(c[j] - c[i])) +
penalty[j] + SEQUENCE`` over the cuts ``i`` at most ``limit`` tokens before ``j``.  Padding is ``limit`` minus length, so
the minimum is that of ``best[i] + c[i]`` over a sliding window and a monotone queue gives it in constant time; lengths
that are powers of two have no padding and are further transitions.

Every group is packed within its task: nothing is shuffled, and a task holds one group of ids and one slice of text.
A token stream longer than a group (one very long document) is cut by the same method segment by segment.

Defined cases: null or empty texts have the end id alone; repeated rows and null ids are packed like any other; an empty
table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, slices
from .tokens import END_ID, default_path, encoder

LIMIT = 2048
GROUP = 1 << 20
STRIDE = 256
SENTENCE, INSIDE, SEQUENCE = 8.0, 64.0, 64.0
SEGMENT = 100_000  # cuts that one run of the dynamic programme looks at

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidates(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, ascending from 0 to its end, and the penalty of each."""
    kind = np.zeros(len(ids) + 1, np.int8)
    kind[1:][stops[ids]] = 2
    kind[doc_ends] = 3
    kind[0] = 3
    at = np.flatnonzero(kind)
    gap = np.diff(at)
    for k in np.flatnonzero(gap > stride):
        kind[at[k] + stride : at[k + 1] : stride] = 1
    at = np.flatnonzero(kind)
    return at, np.array([0.0, INSIDE, SENTENCE, 0.0])[kind[at]]


def best_cuts(at: np.ndarray, penalty: np.ndarray, limit: int = LIMIT) -> list[int]:
    """Indices into ``at`` of the cheapest cuts, first and last included."""
    n = len(at)
    jumps: dict[int, list[int]] = {}
    size = 1
    while size < limit:
        back = np.searchsorted(at, at - size)
        for j in np.flatnonzero(at[np.minimum(back, n - 1)] == at - size).tolist():
            jumps.setdefault(j, []).append(int(back[j]))
        size *= 2
    where, cost = at.tolist(), penalty.tolist()
    best, came = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(where[0]), 0)])  # best[i] + where[i], ascending
    for j in range(1, n):
        here = where[j]
        while where[queue[0][1]] < here - limit:
            queue.popleft()
        value, i = queue[0]
        value += limit - here
        for k in jumps.get(j, ()):
            if best[k] < value:
                value, i = best[k], k
        value += cost[j] + SEQUENCE
        best[j], came[j] = value, i
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def pack_stream(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Where the sequences of the stream begin, and its end."""
    at, penalty = candidates(ids, doc_ends, stops, min(STRIDE, limit))
    cuts = [0]
    for a in range(0, len(at) - 1, SEGMENT):
        part = slice(a, a + SEGMENT + 1)
        cuts += at[part][best_cuts(at[part], penalty[part], limit)][1:].tolist()
    return np.array(cuts)


def pieces(doc_ids: list, encoded: list[bytes], stops: np.ndarray, first: int, limit: int = LIMIT) -> dict:
    """Columns of ``SCHEMA`` for one group; its sequences are numbered from ``first``."""
    buffer = b"".join(encoded)
    ids = np.frombuffer(buffer, "<u4")
    ends = np.cumsum([len(e) // 4 for e in encoded])
    begins = ends - [len(e) // 4 for e in encoded]
    cuts = pack_stream(ids, ends, stops, limit)
    lo = np.union1d(begins, cuts[:-1])
    hi = np.append(lo[1:], len(ids))
    doc = np.searchsorted(begins, lo, side="right") - 1
    sequence = np.searchsorted(cuts, lo, side="right") - 1
    return {
        "doc_id": [doc_ids[d] for d in doc.tolist()],
        "start": lo - begins[doc],
        "length": hi - lo,
        "ids_crc32": [zlib.crc32(buffer[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist())],
        "doc_tokens": (ends - begins)[doc],
        "sequence_id": first + sequence,
        "offset": lo - cuts[sequence],
    }


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, group: int = GROUP
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    limit_batches(docs.sparkSession)
    path = path or default_path()
    types = [pa.int64()] * 7
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        doc_ids, encoded, tokens = [], [], 0

        def flush():
            nonlocal doc_ids, encoded, tokens, sequence
            made = pieces(doc_ids, encoded, model.stops, sequence, limit)
            sequence = int(made["sequence_id"][-1]) + 1
            doc_ids, encoded, tokens = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(made[c], t) for c, t in zip(names, types)], names=names)

        for batch in batches:
            for part in slices(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), model.encode_batch(part.column("text").to_pylist())):
                    doc_ids.append(doc_id)
                    encoded.append(ids + end)
                    tokens += len(ids) // 4 + 1
                    if tokens >= group:
                        yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
