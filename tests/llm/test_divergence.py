"""Operator 13 and its perfect hashes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugelake.llm import divergence as D
from gaugelake.llm import perfecthash as P
from gaugelake.llm import queries

TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def plainly(rows, least=10, top=10):
    """The audit spelled out, over (lang, source, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    documents, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(TERMS, (text or "").translate(lower))
        sources[lang].add(source)
        documents[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        def shares(count, kept=kept):
            total = sum(count(t) for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (count(t) + 2) // total for t in kept}
        p = {s: shares(lambda t, s=s, lang=lang: counts[lang, s][t]) for s in own}
        q = shares(lambda t, lang=lang, own=own: sum(counts[lang, s][t] for s in own))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", item, -v, i) for i, (v, _, item) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", item, -v, i) for i, (v, _, item) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_perfect_hash_is_minimal_and_verified(n):
    keys = [f"key{i}é".encode() for i in range(n)]
    hash_ = P.PerfectHash(keys)
    assert sorted(hash_.slots(pa.array(keys, pa.binary()), P.hashes(keys)).tolist()) == list(range(n))
    assert hash_.keys.take(pa.array(hash_.slots(pa.array(keys, pa.binary()), P.hashes(keys)))).to_pylist() == keys
    others = [f"other{i}".encode() for i in range(20_000)]
    assert (hash_.slots(pa.array(others, pa.binary()), P.hashes(others)) == -1).all()


def test_keys_of_one_hash(monkeypatch):
    """Keys whose hashes are equal get slots of their own, and strings that share the hash are told apart."""
    monkeypatch.setattr(P, "hashes", lambda keys: np.full(len(keys), 7, np.uint64))
    keys = [b"a", b"b", b"c"]
    hash_ = P.PerfectHash(keys)
    assert sorted(hash_.slots(pa.array(keys, pa.binary()), P.hashes(keys)).tolist()) == [0, 1, 2]
    assert hash_.slots(pa.array([b"d"], pa.binary()), P.hashes([b"d"])).tolist() == [-1]


def test_shards_agree_with_spark(spark):
    keys = ["", "a", "é", "term" * 20, "日本語"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", F.pmod(F.xxhash64("k"), F.lit(7)).alias("s")).collect()
    got = P.shard_of(P.hashes([r.k.encode() for r in rows]), 7)
    assert got.tolist() == [r.s for r in rows]


def test_shares_are_exact():
    rng = random.Random(1)
    counts = [[rng.randrange(10**rng.randint(1, 14)) for _ in range(50)] for _ in range(20)]
    totals = [sum(row) + 2 * 50 for row in counts]
    got = D.shares(np.array(counts), np.array(totals))
    assert got.tolist() == [[1 + 10**9 * (c + 2) // t for c in row] for row, t in zip(counts, totals, strict=True)]


def test_shares_in_sql_are_exact(spark):
    rows = [(n, t, 1000) for n, t in ((0, 0), (5, 7), (10**13, 10**14), (9 * 10**14, 10**15))]
    got = spark.createDataFrame(rows, "n bigint, total bigint, terms bigint").select(D.share("n", "total", "terms").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in rows]


def test_term_lists_in_pieces(monkeypatch):
    text = ("Wörter, und $ mehr-9 Zeichen; " * 50).encode()
    whole = [t for part in D.term_lists(text) for t in part]
    monkeypatch.setattr(D, "PIECE", 64)
    parts = list(D.term_lists(text))
    assert len(parts) > 10 and [t for part in parts for t in part] == whole
    assert list(D.term_lists(b"a" * 500)) == [[b"a" * 500]]


def corpus():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "ÄÖ", "äö", "delta", "eps", "日本", "zeta9eta", "x-y", "_"]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "de", "de", None, ""]), rng.choice(["hot"] * 6 + ["a", "b", "ä", None])
        rows.append((lang, source, None if i % 40 == 0 else " ".join(rng.choices(words, range(1, 12), k=rng.randint(0, 30)))))
    rows += [("few", "only", "too few documents")] * 3 + [("few", "other", "")] + [("one", "alone", "same same words")] * 12
    return rows


@pytest.mark.parametrize("options", [
    {}, {"shard_keys": 3, "cells": 4}, {"hash_bytes": 0}, {"hash_bytes": 90, "shard_keys": 2, "pending": 3}, {"open_slots": 1, "pending": 1}])
def test_audit_against_brute_force(spark, options):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert result(D.audit(docs, **options)) == plainly(rows)


def test_rest_of_the_vocabulary_is_counted_too(spark):
    docs = spark.createDataFrame(corpus(), "lang string, source string, text string").fillna("")
    vocabulary = D.document_frequencies(docs).where("documents >= 10").cache()
    assert D.hashed_from(vocabulary) == 0
    some = D.hashed_from(vocabulary, 90)
    assert 0 < vocabulary.where(D.frequency_class(F.col("documents")) >= some).count() < vocabulary.count()
    assert {tuple(r) for r in D.recounted(docs, vocabulary).collect()} == {tuple(r) for r in D.recounted(docs, vocabulary, hash_bytes=90).collect()}


def test_odd_rows(spark, odd_docs, no_docs, odd_rows):
    docs = odd_docs.selectExpr("*", "IF(doc_id % 3 = 0, NULL, 'en') AS lang", "IF(doc_id % 2 = 0, 's', NULL) AS source", "'x' AS term", "1 AS n", "'y' AS item")
    rows = [(None if i is not None and i % 3 == 0 else "en", "s" if i is not None and i % 2 == 0 else None, t) for i, t in odd_rows]
    assert result(D.audit(docs, min_documents=2)) == plainly(rows, least=2)
    empty = no_docs.selectExpr("*", "'en' AS lang", "'s' AS source")
    assert D.audit(empty).collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text").collect()]
    assert result(queries.QUERIES["op13_source_divergence"](spark, sf_dir)) == plainly(rows)
