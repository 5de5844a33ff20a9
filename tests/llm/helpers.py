"""Plain Python versions of the operators' results, and tables with awkward rows."""

import hashlib
import itertools
import re

import numpy as np
import pandas as pd
import xxhash

SF = "/root/testdata/sf0.001"


def passage(seed, words):
    rng = np.random.RandomState(seed)
    out = ["".join(rng.choice(list("abcdefghij"), rng.randint(2, 8))) for _ in range(words)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(out))


def odd_rows():
    """(doc_id, text): nulls, empty, blank, repeated rows, ties, copies, shared passages, a long text, odd characters."""
    shared, other = passage(1, 120), passage(2, 80)
    rows = [
        (0, shared),
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, shared),
        (4, shared),
        (5, passage(3, 40) + ".\n" + shared + ".\n" + passage(4, 30)),
        (6, other.upper()),
        (7, other + " " + passage(5, 25)),
        (None, shared),
        (None, None),
        (8, "a " * 40000),
        (9, "Größe été <|endoftext|> naïve 東京 \U0001f600 it's we'll 12 + é \x1c x"),
        (10, "one two three"),
        (11, "one  two\tthree"),
        (12, passage(6, 9000)),
        (13, passage(6, 9000) + " tail"),
        (14, "x" * 300),
        (15, "x" * 280),
    ]
    return rows


def frame(spark, rows, extra=True):
    """Rows as a documents table; the extra columns clash with names that operators use."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    names = "doc_id long, text string, score double, kept int, row string, key string, bucket int, text_hash string"
    return spark.createDataFrame([(*r, 0.5, None, "r", None, 3, "h") for r in rows], names)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_substrings(rows, length):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < d:
                    mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((d, len(b), mark.count(1), (b"\0" + mark).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return out


def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [w[i : i + 4] for i in range(len(w) - 3)] or [w]
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, bits=4):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            up[find(i)] = find(j)
    least = {}
    for k, d in enumerate(ids):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [least.get(find(k)) for k in range(len(fps))]


def brute_contamination(rows, items, window=13):
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        if item is None or not w:
            continue
        for s in range(max(1, len(w) - window + 1)):
            windows.setdefault(tuple(w[s : s + window]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w = alnum_words(t)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if at := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= at
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def read(name, sf=SF):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x if x is not None else 0) for x in r])
