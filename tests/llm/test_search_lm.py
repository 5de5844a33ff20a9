"""Conversation prefix trie, ranked lexical search and language model scoring against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import lexical, ppm, prefixes, queries

from . import helpers as H

# --- prefix trie -----------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {}
    for c, turns in own.items():
        mine, base = sorted(turns), sorted(own.get(c - c % 100, []))
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = tuple(t[2:] for t in (base[:h] + mine[h:]))
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if convs[c] == p)
        up = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), up, len(who), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversation_rows():
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(0, 30), *range(100, 112), *range(205, 220), *range(300, 340), 100_000, 100_001, 70_000_000_012]:
        for turn in range(rng.integers(0, 9)):
            same = c >= 300 and rng.random() < 0.9  # a family of copies
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"t{turn}" if same else f"é{rng.integers(0, 3)}"))
    rows += [(400, None, "user", "b"), (400, None, "user", "a"), (400, 0, None, None), (400, 0, "user", None)]  # null and equal turns
    rows += [(401, 3, "user", "x"), (401, 3, "user", "x"), (401, 1, None, "")]  # equal rows
    rows += [(None, 0, "user", "x"), (None, None, None, None)]
    rows += [(900, t, "user", "long " * 50) for t in range(300)] + [(903, t, "user", "long " * 50) for t in range(300)]
    return rows


@pytest.mark.parametrize("limit", [None, 3])
def test_trie_equals_plain_version(spark, limit):
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, a int, pos string, shard int").repartition(3)
    out = prefixes.prefix_trie(table, limit=limit).collect()
    assert sorted(map(tuple, out), key=str) == brute_trie(rows)


def test_trie_of_no_conversation(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixes.prefix_trie(empty).count() == 0
    nameless = spark.createDataFrame([(None, 1, "user", "x")], empty.schema)
    assert prefixes.prefix_trie(nameless).count() == 0


def test_trie_on_table(spark):
    t = H.read("conversations")
    out = queries.op11_prefix_trie(spark, H.SF).collect()
    assert sorted(map(tuple, out), key=str) == brute_trie([(int(r.conv_id), int(r.turn), r.role, r.text) for r in t.itertuples()])


def test_ends_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "ID_BLOCK", 7)
    rows = [(c, 0, "user", "x") for c in [*range(-20, 40), 10**12]]
    rows = [(c, t, "user", "x") for c, *_ in rows for t in range(7)]
    out = prefixes.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    ends = ",".join(str(c) for c in sorted({r[0] for r in rows}))
    assert {r.depth: r.ends_sha256 for r in out}[7] == hashlib.sha256(ends.encode()).hexdigest()


@settings(max_examples=50, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300), st.integers(0, 3))
def test_perfect_hash_is_minimal(digests, near):
    keys = sorted(digests) + [(k, 0) for k in range(near)]
    keys = sorted(set(keys))
    a, b = (np.array([k[x] for k in keys], np.uint64) for x in (0, 1))
    table = prefixes.PerfectHash(a, b)
    assert sorted(table.slots(a, b).tolist()) == list(range(len(keys)))
    assert (table.slots(a + np.uint64(1), b) < max(1, len(keys))).all()


def test_equal_digests_of_different_prefixes_raise(spark):
    rows = [(1, 1, 5, 6, 0, 0, 3, True), (2, 1, 5, 6, 0, 0, 4, True)]
    with pytest.raises(Exception, match="one digest"):
        prefixes.counted_nodes(spark.createDataFrame(rows, prefixes.PATHS)).collect()


# --- ranked search ---------------------------------------------------------------------------------------------------


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in lower).split(" ")


def brute_ranking(docs, items, k=50):
    words = [[w for w in terms(t) if w] for _, t in docs]
    n_docs, total = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for x in words for w in set(x))
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= {w for w in terms(t) if w}
    out = []
    for i, own in asked.items():
        found = []
        for (d, _), x in zip(docs, words):
            tf, score = Counter(x), 0
            for w in own & tf.keys():
                m = 50 + (50 * len(x) * n_docs) // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 20 * m))
            if score > 0:
                found.append((-score, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return H.sorted_rows(out)


ITEMS = [(1, H.passage(1, 20)), (2, "one TWO three"), (3, None), (4, " .,!"), (5, "nowhere"), (None, "one"), (6, "a " * 50), (6, "Größe 東京"), (7, H.passage(6, 300))]


@pytest.mark.parametrize("k, head, bucket", [(50, 20_000, 4096), (2, 3, 2)])
def test_ranking_equals_plain_version(spark, monkeypatch, k, head, bucket):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    docs = H.odd_rows() + [(100 + n, H.passage(200 + n % 7, 5 + n % 11) + " one" * (n % 3)) for n in range(60)]
    items = spark.createDataFrame([(*r, 1, 2) for r in ITEMS], "item_id long, text string, q int, rank int")
    out = lexical.rank_documents(H.frame(spark, docs).repartition(3), items, k=k, head=head).collect()
    assert H.sorted_rows(out) == brute_ranking(docs, ITEMS, k)


def test_ranking_in_blocks_of_items(spark):
    docs = H.odd_rows()
    items = spark.createDataFrame([("x%d" % n, t) for n, t in ITEMS if n], "item_id string, text string")
    out = lexical.rank_documents(H.frame(spark, docs), items, block_bytes=700).collect()
    assert H.sorted_rows(out) == brute_ranking(docs, [("x%d" % n, t) for n, t in ITEMS if n])


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.rank_documents(docs, items).count() == 0
    assert lexical.rank_documents(H.frame(spark, H.odd_rows()), items.filter("false")).count() == 0
    assert lexical.rank_documents(H.frame(spark, [(1, None), (2, "")]), items).count() == 0


def random_vectors(seed, n=3000, vocabulary=200):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 30, n)
    rows = [np.sort(rng.choice(vocabulary, s, replace=False)) for s in sizes]
    values = [rng.integers(1, 10 ** rng.integers(2, 7), s) for s in sizes]
    length = np.array([math.sqrt(float((v.astype(float) ** 2).sum())) for v in values])
    order = np.argsort(-length, kind="stable")
    return [rows[r] for r in order], [values[r] for r in order], length[order]


@pytest.mark.parametrize("focus", [0, 1, 6, 50])
def test_pruning_loses_nothing_and_prunes(focus):
    rows, values, length = random_vectors(7)
    rng = np.random.default_rng(8)
    items = [(t, np.sort(rng.integers(1, 3000, len(t)))[::-1]) for t in (rng.choice(200, rng.integers(1, 12), replace=False) for _ in range(40))]
    find = lexical.Search(items, 200, np.ones(40, np.int64), 5, focus)
    for a in range(0, len(rows), 128):
        b = min(len(rows), a + 128)
        start = np.append(0, np.cumsum([len(r) for r in rows[a:b]]))
        find.feed(np.arange(a, b), length[a:b], start, np.concatenate(rows[a:b]), np.concatenate(values[a:b]))
    for (t, w), (score, who) in zip(items, find.best):
        weight = dict(zip(t.tolist(), w.tolist()))
        every = sorted((-sum(weight.get(x, 0) * y for x, y in zip(r.tolist(), v.tolist())), d) for d, (r, v) in enumerate(zip(rows, values)))
        assert list(zip((-score).tolist(), who.tolist())) == [x for x in every[:5] if x[0] < 0]
    if focus == 6:
        assert find.scored < 0.2 * len(rows) * len(items)


def test_files_in_any_order(spark, monkeypatch):
    """A task that reads several files, longest vectors last, finds what it finds in order."""
    rows, values, length = random_vectors(9, 300, 50)
    monkeypatch.setattr(lexical, "BUCKET", 20)
    table = [(d, float(length[d]), [int(x) for x in rows[d]], [int(x) for x in values[d]]) for d in range(300)]
    shuffled = table[200:] + table[100:200] + table[:100]
    item = [(np.arange(10), np.arange(100, 0, -10))]
    schema = "doc_id long, length double, term array<int>, impact array<long>"
    found = [sorted(map(tuple, lexical.search(spark.createDataFrame(t, schema).coalesce(1), item, 50, np.ones(1, np.int64), 7).collect())) for t in (table, shuffled)]
    assert found[0] == found[1] and len(found[0]) == 7


# --- language model --------------------------------------------------------------------------------------------------


def tokens(text):
    return [w.encode() for w in H.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]


def brute_scores(rows, order):
    """PPM with escape method C and exclusion, symbol by symbol over a dictionary of contexts; add-one unigrams."""
    after, count = defaultdict(Counter), Counter()
    out = []
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    text_of = lambda t: b"\n" * order + b" ".join(tokens(t)) + b"\n"
    for (_, t), h in zip(rows, held):
        if not h:
            b = text_of(t)
            for i in range(order, len(b)):
                for j in range(order + 1):
                    after[b[i - j : i]][b[i]] += 1
            count.update([*tokens(t), b"\n"])
    total, distinct = sum(count.values()), len(count)
    for (d, t), h in zip(rows, held):
        b, score = text_of(t), 0.0
        for i in range(order, len(b)):
            excluded = set()
            for j in range(order, -1, -1):
                seen = {x: n for x, n in after.get(b[i - j : i], {}).items() if x not in excluded}
                if not seen:
                    continue
                size = sum(seen.values()) + len(seen)
                if b[i] in seen:
                    score += math.log10(seen[b[i]] / size)
                    break
                score += math.log10(len(seen) / size)
                excluded |= seen.keys()
            else:
                score -= math.log10(256 - len(excluded))
        own = [*tokens(t), b"\n"]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
        out.append((d, h, len(own), sum(count[w] > 0 for w in own), total, base, score))
    return H.sorted_rows(out)


def close(got, want):
    got = H.sorted_rows(got)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order, slice_bytes", [(5, 32 << 20), (2, 500)])
def test_scores_equal_plain_version(spark, order, slice_bytes):
    rows = [(d, t if len(t or "") < 20_000 else t[:3000]) for d, t in H.odd_rows()] + [(100 + n, H.passage(n % 5, 12) + f" Ünseen{n}") for n in range(40)]
    out = ppm.score_texts(H.frame(spark, rows).repartition(3), order=order, slice_bytes=slice_bytes).select(*[x.split()[0] for x in ppm.RESULT.split(", ")])
    want = brute_scores(rows, order)
    assert any(r[1] for r in want)
    close([tuple(r) for r in out.collect()], want)


def test_scores_with_tables_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ppm, "MOST_KEYS", 50)
    monkeypatch.setattr(ppm, "MOST_WORDS", 5)
    monkeypatch.setattr(ppm, "SENT_ROWS", 7)
    monkeypatch.setattr(ppm, "PIECE_BYTES", 100)
    rows = [(n, H.passage(n % 9, 30)) for n in range(50)]
    close([tuple(r) for r in ppm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), order=4).collect()], brute_scores(rows, 4))


def test_scores_without_training_text(spark):
    assert ppm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(n for n in range(1000) if zlib.crc32(str(n).encode()) % 7 == 2)
    rows = [(held, "ab c"), (held, None)]
    out = ppm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    close([tuple(r) for r in out], brute_scores(rows, ppm.ORDER))
    assert {round(r.score, 9) for r in out} == {round(-5 * math.log10(256), 9), round(-math.log10(256), 9)}


def test_probabilities_of_a_context_sum_to_one(spark):
    """All 256 symbols after one context, seen and unseen."""
    from tessera.llm.common import Scratch

    texts = [H.passage(n, 20).encode() for n in range(5)]
    keys, n = np.unique(np.concatenate([ppm.windows([t], 3)[0] for t in texts]), return_counts=True)
    seen = dict(zip(keys.tolist(), n.tolist()))
    contexts = sorted({k >> 8 for k in seen})[::17] + [int.from_bytes(b"zzz", "big"), int.from_bytes(b"za ", "big")]
    rows = [(k, c) for k, c in seen.items()] + [(x << 8 | s, 0) for x in contexts for s in range(256) if x << 8 | s not in seen]
    cost = {r.key: r.cost for r in ppm.code_lengths(spark.createDataFrame(rows, "key long, c long"), 3, Scratch(spark)).collect()}
    for x in contexts:
        assert abs(sum(10 ** cost[x << 8 | s] for s in range(256)) - 1) < 1e-9


def test_model_beats_the_base_on_held_out_documents(spark):
    out = queries.op13_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert len(out) > 50 and out.score.sum() > out.base_score.sum()
