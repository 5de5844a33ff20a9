"""Which hashed keys occur more than once in the whole input, as bitmaps of fixed size.

Tasks send each distinct (key, content) they gathered once -- twice if several documents have it -- as sorted byte planes
of a few bytes per key, in one row per bucket of keys.  A bucket sorts what it gets and marks the keys found twice, and
among those the keys with different contents.  The driver joins the buckets' slices to two bitmaps, whose size does not
depend on the input; a cell that two keys share only marks more than it has to.  The slices are written to the checkpoint
folder, so that what was sent is dropped as soon as they are there.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Scratch, shuffles_dropped

CELL_BITS = 27  # cells of a bitmap: 16 MB
FLUSH = 500_000  # keys that a task gathers before it sends them
BUCKET_ROWS = 1_000_000

_SENT = pa.schema([("bucket", pa.int32()), ("low", pa.binary()), ("content", pa.binary())])


def planes(x: np.ndarray) -> bytes:
    """Byte planes, which the shuffle compresses well where high bytes are equal."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplane(data: bytes, kind: str) -> np.ndarray:
    dtype = np.dtype(kind)
    return np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1).T.copy().view(dtype).ravel()


class Repeats:
    """Bitmaps over hashed keys: repeated at all, and repeated with different contents."""

    def __init__(self, again: bytes, unlike: bytes):
        self.again, self.unlike = again, unlike

    @staticmethod
    def _has(bitmap: bytes, key: np.ndarray) -> np.ndarray:
        cell = key >> np.uint64(64 - CELL_BITS)
        bits = np.frombuffer(bitmap, np.uint8)[(cell >> np.uint64(3)).astype(np.int64)]
        return (bits >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 > 0

    def is_repeated(self, key: np.ndarray) -> np.ndarray:
        return self._has(self.again, key)

    def is_unlike(self, key: np.ndarray) -> np.ndarray:
        return self._has(self.unlike, key)


def bucket_bits(keys: int) -> int:
    """Bits of a key that name its bucket, for about ``BUCKET_ROWS`` keys in each."""
    return min(16, max(6, (keys // BUCKET_ROWS).bit_length()))


def _send(key: np.ndarray, content: np.ndarray, doc: np.ndarray, bits: int) -> pa.RecordBatch:
    order = np.lexsort((doc, content, key))
    key, content, doc = key[order], content[order], doc[order]
    same = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
    head = np.flatnonzero(np.append(True, ~same))
    group = np.cumsum(np.append(True, ~same)) - 1
    twice = np.unique(group[1:][same & (doc[1:] != doc[:-1])])
    kept = np.sort(np.concatenate([head, head[twice]]))
    key, content = key[kept], content[kept]
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    low = ((key >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ranges = list(zip(cuts, np.append(cuts[1:], len(bucket))))
    columns = [bucket[cuts].astype(np.int32), [planes(low[a:b]) for a, b in ranges], [planes(content[a:b]) for a, b in ranges]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)


def find_repeats(
    rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]], bits: int
) -> tuple[Repeats, int, int]:
    """``keys_of`` gives (64-bit keys, 32-bit contents, documents) of a batch of ``rows``.  Returns the bitmaps, and how many
    of the keys sent were marked as repeated and as different."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in keys_of(batch):
                if len(part[0]):
                    held.append(part)
                    n += len(part[0])
                if n >= FLUSH:
                    yield _send(*map(np.concatenate, zip(*held)), bits)
                    held, n = [], 0
        if n:
            yield _send(*map(np.concatenate, zip(*held)), bits)

    def judge(sent: pa.Table) -> pa.Table:
        low, content = (np.concatenate([unplane(x, "<u4") for x in sent.column(c).to_pylist()]) for c in ("low", "content"))
        both = np.sort((low.astype(np.uint64) << np.uint64(32)) | content)
        low = both >> np.uint64(32)
        same = low[1:] == low[:-1]
        cells = CELL_BITS - bits
        found, n = [], []
        for at in (same, same & (both[1:] != both[:-1])):
            which = np.unique(low[1:][at])
            marks = np.zeros(1 << cells, np.uint8)
            marks[(which >> np.uint64(32 - cells)).astype(np.int64)] = 1
            found.append(zlib.compress(np.packbits(marks).tobytes(), 1))
            n.append(int((np.searchsorted(low, which, side="right") - np.searchsorted(low, which)).sum()))
        names = ("bucket", "again", "unlike", "n_again", "n_unlike")
        values = (pa.array([sent.column("bucket")[0].as_py()], pa.int32()), [found[0]], [found[1]], [n[0]], [n[1]])
        return pa.table(dict(zip(names, values)))

    sent = rows.mapInArrow(emit, "bucket int, low binary, content binary")
    marked = sent.groupBy("bucket").applyInArrow(judge, "bucket int, again binary, unlike binary, n_again long, n_unlike long")
    size = 1 << (CELL_BITS - bits - 3)
    maps = [bytearray(1 << (CELL_BITS - 3)), bytearray(1 << (CELL_BITS - 3))]
    n_again = n_unlike = 0
    scratch = Scratch(rows.sparkSession)
    with shuffles_dropped(rows.sparkSession):
        marked = scratch.cut(marked)
    for r in marked.toLocalIterator():
        for bitmap, part in zip(maps, (r.again, r.unlike)):
            bitmap[r.bucket * size : (r.bucket + 1) * size] = zlib.decompress(part)
        n_again, n_unlike = n_again + r.n_again, n_unlike + r.n_unlike
    scratch.drop(marked)
    return Repeats(*map(bytes, maps)), n_again, n_unlike
