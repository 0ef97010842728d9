"""Operators 3 and 4 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelake.llm import queries, repeats, suffixes, wordwindows

HUGE = 2**63


def brute(rows, units_of, width):
    """(doc_id, units, marks of removed ones) of each row."""
    units = [(i, units_of(t or "")) for i, t in rows]
    first = {}
    for i, u in units:
        for k in range(len(u) - width + 1):
            window = tuple(u[k:k + width])
            first[window] = min(first.get(window, HUGE), HUGE if i is None else i)
    out = []
    for i, u in units:
        marks = [False] * len(u)
        for k in range(len(u) - width + 1):
            if first[tuple(u[k:k + width])] < (HUGE if i is None else i):
                marks[k:k + width] = [True] * width
        out.append((i, u, marks))
    return out


def want_words(rows, width=13):
    return Counter(
        (i, len(u), sum(m), hashlib.sha256(b" ".join(w for w, gone in zip(u, m) if not gone)).hexdigest())
        for i, u, m in brute(rows, lambda t: t.encode().split(), width))


def want_bytes(rows, width=50):
    return Counter(
        (i, len(u), sum(m), sum(b and not a for a, b in zip([False, *m], m)), hashlib.sha256(bytes(b for b, gone in zip(u, m) if not gone)).hexdigest())
        for i, u, m in brute(rows, lambda t: t.encode(), width))


def test_word_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, queries.QUERIES["op3_substring_dedup"](spark, sf_dir).collect())) == want_words(docs)


def test_byte_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, queries.QUERIES["op4_suffix_array_dedup"](spark, sf_dir).collect())) == want_bytes(docs)


@pytest.mark.parametrize("hot_docs", [2, 50_000])
def test_odd_rows(odd_docs, odd_rows, no_docs, hot_docs):
    """Also with every repeated minimiser divided."""
    got = wordwindows.without_repeats(odd_docs, 13, hot_docs=hot_docs)
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()) == want_words(odd_rows)
    short = [r for r in odd_rows if len(r[1] or "") < 100_000]
    got = suffixes.without_repeats(odd_docs.filter("text IS NULL OR length(text) < 100000"), 50, hot_docs=hot_docs)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()) == want_bytes(short)
    assert wordwindows.without_repeats(no_docs).count() == suffixes.without_repeats(no_docs).count() == 0


def test_rows_without_ids_do_not_share_a_row(spark, monkeypatch):
    """Each text gets its own minimisers and spans, not those of all rows without an id; repeated rows get them once."""
    passages = [" ".join(f"p{i}w{k}" for k in range(40)) for i in range(12)]
    rows = [(i, f"start {p} end") for i, p in enumerate(passages)]
    rows += [(None, f"no id {i} {p} and more {i}") for i, p in enumerate(passages)] + [(None, f"again {passages[0]}")] * 30
    rows += [(99, f"one id {p} many texts {i}") for i, p in enumerate(passages)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes, names, plain, write = [], [], repeats._super_kmers, repeats.stored

    def super_kmers(docs, kind):
        units = F.size(F.split("text", " ")) if isinstance(kind, wordwindows.WordWindows) else F.octet_length("text")
        sizes.append([tuple(r) for r in docs.select(F.size("hs"), units).collect()])
        return plain(docs, kind)

    def stored(part, name):
        out = write(part, name)
        if name == "repeats-marks":
            names.append(out.columns)
            sizes.append([tuple(r) for r in out.select(F.size("spans"), F.lit(5)).collect()])
        return out

    monkeypatch.setattr(repeats, "_super_kmers", super_kmers)
    monkeypatch.setattr(repeats, "stored", stored)
    got = wordwindows.without_repeats(df, 13).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == want_words(rows)
    got = suffixes.without_repeats(df, 50).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == want_bytes(rows)
    words, word_marks, strings, _ = sizes
    for some in (words, strings):
        assert len(some) == len(rows) and all(0 < n <= units for n, units in some)
    assert len(word_marks) == 25 and all("tkey" in columns for columns in names)


def test_a_minimiser_of_all_documents_is_no_window(spark):
    """Counted by an aggregate with a part before the shuffle; each document has a few minimisers of its own."""
    line = " ".join(f"licence{k}" for k in range(30))
    rows = [(i, f"{line} {' '.join(f'own{i}x{k}' for k in range(20))}") for i in range(400)] + [(7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    kind, holders = wordwindows.WordWindows(13), {}
    for i, text in rows:
        for h in set(kind.minimisers(kind.units(text or ""), 0).astype(np.int64).tolist()):
            holders.setdefault(h, set()).add(i)
    want = {(h, len(ids) >= 100) for h, ids in holders.items() if len(ids) > 1}
    shared = repeats._shared(docs, kind, 100)
    assert {tuple(r) for r in shared.collect()} == want and any(hot for _, hot in want)
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_sum" in plan
    assert repeats._shared(docs.limit(0), kind, 100).count() == 0


def test_whole_characters(spark):
    docs = spark.createDataFrame([(1, "é" * 60 + "ab"), (2, "ã" + "é" * 60 + "cd")], "doc_id bigint, text string")
    for r in suffixes.without_repeats(docs, 21, whole_characters=True, carry=("text",)).collect():
        text = r.kept.decode()
        assert r.doc_id == 1 and text == r.carried["text"] or text == "ãcd"


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(1, 200)))
        depth = rng.choice([8, 13, 16, 50])
        order = suffixes.suffix_array(np.frombuffer(data, np.uint8), depth).tolist()
        assert sorted(order) == list(range(len(data)))
        assert [data[i:i + depth] for i in order] == sorted(data[i:i + depth] for i in range(len(data)))
    for run in (b"a" * 5000, b"ab" * 3000, b"b" + b"a" * 4000 + b"c"):
        order = suffixes.suffix_array(np.frombuffer(run, np.uint8), 50)
        assert [run[i:i + 50] for i in order] == sorted(run[i:i + 50] for i in range(len(run)))
