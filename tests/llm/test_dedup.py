import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontam, repeats, simhash, spans, suffix

from . import helpers as H


def got(df, *columns):
    return H.sorted_rows(df.select(*columns).collect())


# --- substrings over the sampled suffix array -------------------------------------------------------------------------


@pytest.mark.parametrize("length", [50, 20])
def test_substrings_odd_rows(spark, length):
    rows = [r for r in H.odd_rows() if r[0] not in (8, 12, 13)] + [(20, "ab" * 400), (21, "ba" * 300)]
    df = suffix.substring_digest(H.frame(spark, rows), length=length)
    found = got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == H.sorted_rows(H.brute_substrings(rows, length))


def test_substrings_on_table(spark):
    docs = H.read("documents")
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    df = suffix.substring_digest(spark.read.parquet(f"{H.SF}/documents.parquet"))
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == H.sorted_rows(H.brute_substrings(rows, 50))


def test_substrings_many_flushes_and_buckets(spark, monkeypatch):
    """Small sends and many buckets over many partitions give the same rows."""
    monkeypatch.setattr(suffix, "FLUSH", 500)
    monkeypatch.setattr(repeats, "FLUSH", 700)
    monkeypatch.setattr(suffix, "BUCKET_ROWS", 300)
    monkeypatch.setattr(suffix, "SAMPLE_DOCS", 5)
    docs = H.read("documents").head(60)
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    df = suffix.substring_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == H.sorted_rows(H.brute_substrings(rows, 50))


def test_substrings_keep_text(spark):
    rows = [(1, "A" * 10 + H.passage(1, 30)), (2, H.passage(1, 30) + "!tail"), (3, None)]
    kept = {r.doc_id: bytes(r.kept) for r in suffix.dedup_substrings(H.frame(spark, rows)).collect()}
    assert kept == {1: rows[0][1].encode(), 2: b"!tail", 3: b""}


def test_substrings_drop_what_finished_steps_sent(spark):
    """Of the four steps' shuffles none is left when the spans are there."""
    import time
    from pathlib import Path

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def sent():
        files = [Path(manager.getAllFiles().apply(k).getPath()) for k in range(manager.getAllFiles().size())]
        return {f.name: f.stat().st_size for f in files if f.name.startswith("shuffle_") and f.suffix == ".data" and f.exists()}

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(3000)]
    rows = [(k, " ".join(rng.choice(words, 400))) for k in range(60)]
    rows += [(60 + k, t) for k, (_, t) in enumerate(rows[:30])]
    before = set(sent())
    spans = suffix.removed_spans(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    assert spans.count() == 30
    for _ in range(100):  # files go in the background
        left = sum(n for f, n in sent().items() if f not in before)
        if left < 20_000:
            break
        time.sleep(0.2)
    assert left < 20_000


def test_substrings_of_one_id_with_many_rows(spark, monkeypatch):
    """The sample that balances the buckets counts different rows, whatever their ids."""
    monkeypatch.setattr(suffix, "SAMPLE_DOCS", 3)
    monkeypatch.setattr(suffix, "BUCKET_ROWS", 10)
    rows = [(7, H.passage(k, 20)) for k in range(30)] + [(9, H.passage(2, 20) + H.passage(5, 20))] * 4
    df = suffix.substring_digest(H.frame(spark, rows))
    found = got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == H.sorted_rows(H.brute_substrings(rows, 50))


def test_substrings_empty_table(spark):
    assert suffix.substring_digest(H.frame(spark, [])).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab", min_size=20, max_size=140), min_size=1, max_size=5))
def test_runs_cover_every_window(texts):
    """Each window of a document lies in one run of either step, and equal windows have equal anchors."""
    length = 48
    data = [t.encode() for t in texts]
    text = suffix.Text(data, length)
    for runs in (text.runs(), text.finer(text.runs())):
        check_runs(text, runs, data, length)


def check_runs(text, runs, data, length):
    seen = {}
    for d, f, n, a in zip(text.document(runs.first), runs.first, runs.size, runs.anchor):
        for k in range(n):
            at = f + k - text.begin[d]
            assert (d, at) not in seen
            seen[d, at] = a
    want = {(d, at) for d, b in enumerate(data) for at in range(len(b) - length + 1)}
    assert set(seen) == want
    by = {}
    for (d, at), a in seen.items():
        assert by.setdefault(data[d][at : at + length], a) == a


# --- SimHash ----------------------------------------------------------------------------------------------------------


def test_fingerprint_matches_definition():
    for _, text in H.odd_rows():
        assert simhash.fingerprint(text.encode() if text else None) == H.brute_fingerprint(text)


def test_near_duplicates_odd_rows(spark):
    rows = [r for r in H.odd_rows() if r[0] != 12]
    found = got(simhash.near_duplicates(H.frame(spark, rows)), "doc_id", "fingerprint", "component_id")
    fps = [H.brute_fingerprint(t) for _, t in rows]
    want = zip([r[0] for r in rows], [f"{f:016x}" for f in fps], H.brute_components(fps, [r[0] for r in rows]))
    assert found == H.sorted_rows(want)


def test_near_duplicates_on_table(spark):
    docs = H.read("documents")
    fps = [H.brute_fingerprint(t) for t in docs.text]
    ids = docs.doc_id.tolist()
    found = got(simhash.near_duplicates(spark.read.parquet(f"{H.SF}/documents.parquet")), "doc_id", "fingerprint", "component_id")
    assert found == H.sorted_rows(zip(ids, [f"{f:016x}" for f in fps], H.brute_components(fps, ids)))


def close_fingerprints(n, seed=0):
    """Groups of fingerprints a few bits apart, chains included."""
    rng = np.random.RandomState(seed)
    out = set()
    while len(out) < n:
        base = int(rng.randint(0, 1 << 62)) * 4 + int(rng.randint(0, 4))
        for _ in range(12):
            for b in rng.choice(64, rng.randint(0, 6), replace=False):
                base ^= 1 << int(b)
            out.add(base)
    return sorted(out)


@pytest.mark.parametrize("cell_rows", [20_000, 3])
def test_links_connect_what_all_pairs_connect(spark, cell_rows):
    """Cells cut into chunks (of three rows) lose no link."""
    fps = close_fingerprints(300)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long").repartition(3)
    edges = simhash.links(df, cell_rows=cell_rows)
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 64 for r in edges.collect())
    roots = {r.u: r.root for r in simhash.components(edges).collect()}
    labels = [roots.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    want = H.brute_components(fps, list(range(len(fps))))
    groups = lambda x: {frozenset(k for k, y in enumerate(x) if y == v) for v in x}
    assert groups(labels) == groups(want)


def all_pairs(cell, fps, bits=4):
    found = list(simhash.trie_pairs(cell, fps, bits))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, int)] * 2


def test_trie_pairs_match_all_pairs():
    fps = np.array(close_fingerprints(250, 3), np.uint64)
    cell = np.repeat([0, 1], [150, 100])[: len(fps)]
    cell = np.pad(cell, (0, len(fps) - len(cell)), constant_values=1)
    a, b = all_pairs(cell, fps)
    want = {
        (i, j)
        for i, j in itertools.combinations(range(len(fps)), 2)
        if cell[i] == cell[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4
    }
    found = [(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())]
    assert len(found) == len(set(found)) and set(found) == want


def test_trie_frontier_is_bounded(monkeypatch):
    fps = np.array(close_fingerprints(200, 4), np.uint64)
    want = sorted(zip(*(x.tolist() for x in all_pairs(np.zeros(len(fps), int), fps))))
    monkeypatch.setattr(simhash, "FRONTIER", 16)
    assert sorted(zip(*(x.tolist() for x in all_pairs(np.zeros(len(fps), int), fps)))) == want


def test_dense_cell_is_folded(monkeypatch):
    """4,048 fingerprints near one another, a million pairs and more: a task folds them a bounded number at a time."""
    monkeypatch.setattr(simhash, "FRONTIER", 1 << 14)
    low = [sum(1 << b for b in c) for n in range(4) for c in itertools.combinations(range(29), n)]
    fps = np.sort(np.array(low, np.uint64))
    label, pairs, most = np.arange(len(fps)), 0, 0
    for i, j in simhash.trie_pairs(np.zeros(len(fps), int), fps):
        label = simhash.forest(label, i, j)
        pairs, most = pairs + len(i), max(most, len(i))
    assert pairs > 10**6 and most <= 1 << 14 and not label.any()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(-40, 60)] + [(100, 300), (300, 200)], "u long, v long")
    roots = {r.u: r.root for r in simhash.components(edges).collect()}
    assert roots == {k: -40 for k in range(-39, 61)} | {300: 100, 200: 100}


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(H.frame(spark, [])).collect() == []


def test_more_bits_than_blocks_allow(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), bits=5)


# --- sentence spans ---------------------------------------------------------------------------------------------------


def brute_spans(rows):
    """First occurrence of every hashed run over all documents; what every other covers goes."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    parts = [spans.sentences(t.encode() if t is not None else None) for _, t in rows]
    first, covered = {}, {}
    for k in order:
        for key, at, size in spans.runs(parts[k]):
            place = (rows[k], at)
            if first.setdefault(key, place) != place:
                covered.setdefault(k, []).extend([at, size])
    return [spans.cut_text(t.encode() if t is not None else None, covered.get(k)) for k, (_, t) in enumerate(rows)]


def test_spans_on_table(spark):
    docs = H.read("documents")
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    found = got(spans.dedup_spans(spark.read.parquet(f"{H.SF}/documents.parquet").repartition(5)), "doc_id", "text", "n_sentences", "n_removed")
    want = [(d, kept.decode(), n, gone) for (d, _), (kept, n, gone) in zip(rows, brute_spans(rows))]
    assert found == H.sorted_rows(want)
    assert sum(r[3] for r in want) > 0


def test_spans_catch_shared_passages_and_leave_the_rest(spark):
    own = [H.passage(k, 60) + "." for k in (11, 12, 13)]
    shared = H.passage(1, 70) + "."
    rows = [(1, own[0] + "\n" + shared), (2, shared + "\n" + own[1]), (3, own[2]), (4, None), (5, "")]
    kept = {r.doc_id: r.text for r in spans.dedup_spans(H.frame(spark, rows)).collect()}
    assert kept == {1: rows[0][1], 2: own[1], 3: own[2], 4: "", 5: ""}


def test_spans_odd_rows(spark):
    rows = H.odd_rows()
    df = spans.dedup_spans(H.frame(spark, rows)).collect()
    assert len(df) == len(rows)
    by = {}
    for r in df:
        by.setdefault(r.doc_id, set()).add(r.text)
    assert len(by[4]) == 1  # repeated rows are one document
    assert by[3] == {" \n\t "} and by[2] == {""}


@pytest.mark.parametrize("partitions", [1, 2])
def test_spans_of_equal_rows_are_no_repeats_of_each_other(spark, partitions):
    """Equal rows are one document on any layout; what repeats an earlier place in them still goes."""
    text, twice = H.passage(61, 80) + ".", H.passage(62, 60) + "."
    rows = [(7, text), (8, twice + "\n" + twice), (None, H.passage(63, 60) + ".")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows * 2, partitions), "doc_id long, text string")
    assert df.rdd.getNumPartitions() == partitions
    want = [(7, text), (8, twice), rows[2]]
    assert got(spans.dedup_spans(df), "doc_id", "text") == H.sorted_rows(want * 2)
    assert got(spans.filter_rows(df), "doc_id", "text") == H.sorted_rows(want * 2)


def test_spans_catch_two_short_sentences_between_glued_ends(spark):
    """A shared passage whose ends are glued to other text: its two whole sentences, of 22 words in all, go."""
    w = H.passage(71, 53).replace(".", "").split()
    inner = " ".join(w[16:22]) + ". " + " ".join(w[22:38]) + "."
    shared = " ".join(w[:16]) + ". " + inner + " " + " ".join(w[38:])
    rows = [(k, f"{H.passage(72 + k, 5)} {shared} {H.passage(75 + k, 6)}.") for k in (1, 2)]
    kept = {r.doc_id: r.text for r in spans.dedup_spans(H.frame(spark, rows)).collect()}
    assert kept == {1: rows[0][1], 2: rows[1][1].replace(inner + " ", "")}


def test_spans_filter_keeps_columns(spark):
    df = H.frame(spark, [(1, H.passage(1, 70) + "."), (2, H.passage(1, 70) + "."), (3, None)])
    out = spans.filter_rows(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_spans_empty_table(spark):
    assert spans.dedup_spans(H.frame(spark, [])).collect() == []


# --- decontamination --------------------------------------------------------------------------------------------------

ITEMS = [(1, H.passage(21, 40)), (2, "few words only"), (3, None), (4, ""), (None, H.passage(22, 30)), (10, H.passage(21, 40)), (5, "the the " * 12)]
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def dirty_rows():
    item = H.passage(21, 40)
    return H.odd_rows() + [
        (30, "Before " + item.upper() + " after"),
        (31, " ".join(item.split()[5:19]) + " " + H.passage(40, 300)),
        (32, " ".join(item.split()[5:17])),
        (33, "we have few, words; only here"),
        (34, "the " * 40),
        (35, H.passage(22, 30)),
        (36, item + " " + item),
    ]


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_contamination_odd_rows(spark, block_bytes):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    df = decontam.decontaminate(H.frame(spark, dirty_rows()), items, block_bytes=block_bytes)
    assert got(df, *COLUMNS) == H.sorted_rows(H.brute_contamination(dirty_rows(), ITEMS))


def test_contamination_on_table(spark):
    docs, items = H.read("documents"), H.read("benchmark")
    want = H.brute_contamination(list(zip(docs.doc_id.tolist(), docs.text)), list(zip(items.item_id, items.text)))
    df = decontam.decontaminate(spark.read.parquet(f"{H.SF}/documents.parquet"), spark.read.parquet(f"{H.SF}/benchmark.parquet"))
    assert got(df, *COLUMNS) == H.sorted_rows(want)
    assert any(r[5] for r in want)


def test_repetitive_texts_stay_small():
    """A word repeated a million times against items that repeat it: one look-up an item, one run."""
    items = [decontam.words_of(b"the " * 200), decontam.words_of(b"the a " * 100)]
    index = decontam.rarest_positions(items, {}, 13)
    assert sum(map(len, index.values())) <= 4
    assert decontam.scan(decontam.words_of(b"the " * 1_000_000), items, index, 13) == ([(0, 999_999)], {0})


def test_contamination_of_repetitive_items(spark):
    items = [(1, "a b " * 20), (2, "a " * 30), (3, "a b c " * 7 + "d " * 20), (4, "b a " * 6 + "b")]
    rows = [(k, t) for k, t in enumerate(["a b " * 7, "b a " * 7, "a " * 12, "a " * 13, "x " + "a b c " * 5, "d " * 40, "c d d d d d d d d d d d d", "a b " * 6 + "a c", ""])]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontam.decontaminate(H.frame(spark, rows), table), *COLUMNS) == H.sorted_rows(H.brute_contamination(rows, items))


def test_contamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(1, "a b"), (2, None)]
    assert got(decontam.decontaminate(H.frame(spark, rows), none), *COLUMNS) == H.sorted_rows(H.brute_contamination(rows, []))
    assert decontam.decontaminate(H.frame(spark, []), none).collect() == []


def test_contamination_filter(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = H.frame(spark, dirty_rows())
    bad = {r[0] for r in H.brute_contamination(dirty_rows(), ITEMS) if r[5]}
    out = decontam.filter_rows(df, items)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {r[0] for r in dirty_rows()} - bad
