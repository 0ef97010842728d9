"""The pipeline against a brute-force version, and each stage on odd rows."""

import zlib
from collections import Counter

import corpus_pipeline as P
from gaugelake.llm import packing, quality, queries, secretscan, suffixes
from test_packing_sharding import check_packed, want_pieces
from test_repeats import brute
from test_search_dedup import plain_components


def plain_cut(rows, width=50):
    out = []
    for i, data, marks in brute(rows, lambda t: t.encode(), width):
        at = 0
        while at < len(data):  # whole characters: a run gives up the part of one at its ends
            if not marks[at]:
                at += 1
                continue
            a = at
            while at < len(data) and marks[at]:
                at += 1
            b = at
            while a < b and data[a] & 0xC0 == 0x80:
                marks[a], a = False, a + 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
                marks[b] = False
        out.append((i, bytes(x for x, gone in zip(data, marks) if not gone).decode()))
    return out


def test_pipeline_equals_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in quality.judged(docs).filter("kept").collect()]
    assert 0 < len(rows) < docs.count()
    component = {i: c for i, _, c in plain_components(rows, 5, 80)}
    rows = [(i, t) for i, t in rows if component[i] == i]
    rows = plain_cut(rows)
    rows = [(i, secretscan.redacted(t, sorted(secretscan.base_spans(t) + secretscan.confirmed_spans(t)))) for i, t in rows]
    out = P.run(spark, sf_dir).collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want_pieces(tokenizer, rows, packing.CAPACITY)
    check_packed(out, packing.CAPACITY)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in out)


def test_stages_on_odd_rows(spark, odd_docs, odd_rows, no_docs):
    for docs in (odd_docs, no_docs):
        docs = docs.selectExpr("*", "length(text) AS n_chars", "map('a', 1) AS extra")
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
        assert P.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def test_near_dedup_keeps_one_of_equal_rows(spark, odd_docs, odd_rows):
    kept = Counter((r.doc_id, r.text) for r in P.near_dedup(spark, odd_docs, "").collect())
    assert set(kept.values()) == {1}
    assert (6, odd_rows[6][1]) in kept and not {odd_rows[7], odd_rows[8]} & set(kept)


def test_clean_text_is_left_alone(spark):
    text = " ".join(f"word{i} and the" for i in range(80))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert docs.collect() == [(1, text)] and suffixes.without_repeats(docs).first().n_removed == 0
