import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import lengths, packing, simhash, spans, tokens

from . import helpers as H
from .test_dedup import brute_spans

END = [tokens.END_ID]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aAéÜß'ſsſtİΣ ς\n\t.!<|>endoftext129\u00a0\u0301\u2028", max_size=30)), max_size=5))
def test_word_encoder_equals_the_tokenizer(texts):
    model = tokens.encoder(tokens.default_path())
    for text, ids in zip(texts, model.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == model.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_encoder_on_documents(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 500)  # the cache is emptied again and again
    model = tokens.WordEncoder(tokens.default_path())
    texts = H.read("documents").text.head(80).tolist()
    for a in range(0, len(texts), 8):
        for text, ids in zip(texts[a : a + 8], model.encode_batch(texts[a : a + 8])):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(tokenizer, text)


def check_pieces(rows, pieces, tokenizer, limit=packing.LIMIT):
    """Every id of every document lies in exactly one piece; sequences are gapless and at most ``limit`` long."""
    want = sorted((d is None, d or 0, x) for d, t in rows for x in [ids_of(tokenizer, t) + END])
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    ids = {}
    for none, d, x in want:
        ids.setdefault(None if none else d, []).append(x)
    assert set(ids) == set(by_doc)
    for d, texts in ids.items():
        found = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[d])
        for x in texts:
            assert sum(p.length for p in by_doc[d]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for start, length, crc, n in found:
                assert (start, n) == (at, len(texts[0])) and length > 0
                assert crc == zlib.crc32(np.array(texts[0][at : at + length], "<u4").tobytes())
                at += length
            assert at == len(texts[0])
    padding = total = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
        total += at
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding / max(1, total)


def test_pack_odd_rows(spark, tokenizer):
    rows = H.odd_rows()
    check_pieces(rows, packing.pack(H.frame(spark, rows)).collect(), tokenizer)
    assert packing.pack(H.frame(spark, [])).collect() == []


def test_pack_table_with_little_padding(spark, tokenizer):
    docs = H.read("documents")
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    assert check_pieces(rows, packing.pack(spark.read.parquet(f"{H.SF}/documents.parquet")).collect(), tokenizer) < 0.01


def test_pack_keeps_the_order(spark):
    pieces = packing.pack(spark.read.parquet(f"{H.SF}/documents.parquet").coalesce(1).sortWithinPartitions("doc_id")).collect()
    order = [(p.doc_id, p.start) for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert order == sorted(order)


def test_pack_groups_and_segments(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 7)
    docs = H.read("documents").head(40)
    model = tokens.encoder(tokens.default_path())
    encoded = [e + np.array(END, "<u4").tobytes() for e in model.encode_batch(docs.text.tolist())]
    made = packing.pieces(docs.doc_id.tolist(), encoded, model.stops, 0, 64)
    Piece = __import__("collections").namedtuple("Piece", made)
    check_pieces(list(zip(docs.doc_id, docs.text)), [Piece(*x) for x in zip(*made.values())], tokenizer, 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0.0, 8.0, 64.0])), min_size=1, max_size=14))
def test_best_cuts_are_optimal(steps):
    limit = 16
    at = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    penalty = np.array([0.0] + [p for _, p in steps])

    def cost(cuts):
        total = 0.0
        for a, b in zip(cuts, cuts[1:]):
            n = at[b] - at[a]
            if n > limit:
                return float("inf")
            total += (0 if n & (n - 1) == 0 else limit - n) + penalty[b] + packing.SEQUENCE
        return total

    best = {0: 0.0}
    for j in range(1, len(at)):
        best[j] = min(best[i] + cost([i, j]) for i in range(j))
    found = packing.best_cuts(at, penalty, limit)
    assert found[0] == 0 and found[-1] == len(at) - 1
    assert abs(cost(found) - best[len(at) - 1]) < 1e-9


# --- token counts -----------------------------------------------------------------------------------------------------


def test_length_histogram(spark, tokenizer):
    docs = H.read("documents")
    n = np.array([len(ids_of(tokenizer, t)) for t in docs.text])
    out = lengths.suffix_sums(lengths.length_histogram(spark.read.parquet(f"{H.SF}/documents.parquet")), block=64).cache()
    rows = {r.length: r for r in out.collect()}
    assert set(rows) == set(n.tolist())
    for length, r in rows.items():
        assert (r.n_docs, r.docs_from, r.tokens_from) == ((n == length).sum(), (n >= length).sum(), n[n >= length].sum())
        assert r.truncated_tokens == np.minimum(n, length).sum()
        assert abs(r.share_upto - (n <= length).mean()) < 1e-12
    limits = [0, 1, 100, 2048, 10**6]
    for r in lengths.at_limits(out, limits).collect():
        assert (r.docs_cut, r.tokens_left) == ((n > r.context).sum(), np.minimum(n, r.context).sum())


def test_length_histogram_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "one"), (None, "one"), (3, " \n")]
    out = lengths.suffix_sums(lengths.length_histogram(H.frame(spark, rows))).collect()
    assert sorted((r.length, r.n_docs, r.docs_from) for r in out) == [(0, 3, 5), (1, 2, 2)]
    assert lengths.suffix_sums(lengths.length_histogram(H.frame(spark, []))).collect() == []


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tokenizer):
    import corpus_pipeline
    from tessera.llm import rules

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "pack_sequences"]
    docs, items = H.read("documents"), H.read("benchmark")
    judged = rules.quality_rules(*(spark.read.parquet(f"{H.SF}/{t}.parquet") for t in ("documents", "labels"))).toPandas()
    rows = [(d, t) for d, t in zip(docs.doc_id.tolist(), docs.text) if d in set(judged.doc_id[judged.kept])]
    components = H.brute_components([H.brute_fingerprint(t) for _, t in rows], [d for d, _ in rows])
    rows = [r for r, c in zip(rows, components) if r[0] == c]
    rows = [(d, kept.decode()) for (d, _), (kept, _, _) in zip(rows, brute_spans(rows)) if kept]
    dirty = {r[0] for r in H.brute_contamination(rows, list(zip(items.item_id, items.text))) if r[5]}
    rows = [r for r in rows if r[0] not in dirty]
    assert 0 < len(rows) < len(docs) and dirty
    check_pieces(rows, corpus_pipeline.run(spark, H.SF).collect(), tokenizer)


def test_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (H.odd_rows(), []):
        docs = H.frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "pack_sequences":
                assert out.schema.simpleString() == docs.schema.simpleString()
            out.collect()
            docs = out


A, B, C = H.passage(1, 80), H.passage(2, 80), H.passage(3, 80)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(3, A), (1, A), (2, B), (None, B)], [(1, A), (2, B)]),
        ([(1, A), (2, A), (2, B)], [(1, A), (2, B)]),  # an id with two texts keeps the clean one
        ([(1, A), (1, A), (1, A)], [(1, A)]),  # equal rows are copies
        ([(None, A), (None, A), (None, C), (5, B)], [(5, B), (None, A), (None, C)]),
        ([(None, None), (None, ""), (4, None)], [(4, None)]),  # texts without words are one group
    ],
)
def test_simhash_filter_keeps_one_row_of_each_group(spark, rows, want):
    for parts in (1, 3):
        df = H.frame(spark, rows).repartition(parts)
        out = simhash.filter_rows(df)
        assert out.schema == df.schema
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_pipeline_with_repeated_ids(spark, tmp_path):
    """Ids that occur with several texts and rows that are null or equal: every clean text reaches the sequences once."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, A), (2, A), (2, B), (None, C), (None, C), (7, A)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], names).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({str(r.doc_id) for r in out}) == ["1", "2", "None"]
    from tokenizers import Tokenizer

    size = {t: len(ids_of(Tokenizer.from_file(tokens.default_path()), t)) + 1 for t in (A, B, C)}
    assert sum(r.length for r in out) == sum(size.values())


def test_spans_do_not_change_untouched_texts():
    text = b"  One. Two!\n\n Three\tfour  \n"
    assert spans.cut_text(text, None) == (text, 3, 0)
