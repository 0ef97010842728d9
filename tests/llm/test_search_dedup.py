"""Operators 6, 9 and 10, and the queries that have SQL checks."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
from gaugelake.llm import bpe, neardup, queries, topk, wordbpe
from gaugelake.llm.components import components
from gaugelake.llm.oracle import ORACLES
from gaugelake.llm.shared import stored
from oracle_check import compare, duck


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(contract.queries()[name](spark, sf_dir), duck(sf_dir), ORACLES[name]) == []


def test_all_are_registered():
    for n in range(1, 11):
        assert any(name.startswith(f"op{n}_") for name in contract.queries())
    assert "pipeline" in contract.queries()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_query(spark, sf_dir, tokenizer):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.QUERIES["op6_bpe_roundtrip"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_odd_rows(odd_docs, odd_rows, no_docs, tokenizer):
    path = queries.tokenizer_path()
    got = sorted(((r.doc_id, r.ids) for r in bpe.encoded(odd_docs, path).collect()), key=str)
    want = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in odd_rows]
    assert got == sorted(((i, bytearray(b)) for i, b in want), key=str)
    assert bpe.decoded(bpe.encoded(no_docs, path), path).count() == 0


def test_encoder_equals_library(tokenizer):
    words, rng = wordbpe.encoder(queries.tokenizer_path()), random.Random(3)
    letters = "abZ É'.,;!?<|>\n\t\x0b\x85\xa0\x1c0²½ªµßÿİΣςœ’s'tll’é́-_ \u3000日𝒳ŉ"
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        text += "<|endoftext|>" + text[:3] if rng.random() < 0.2 else ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == np.array(ids, "<u4").tobytes()
        assert words.decode(words.encode(text)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_chunks_and_joins(tokenizer):
    words, rng = wordbpe.encoder(queries.tokenizer_path()), random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["é", "word ", "ab", ".", " ", "日", "x" * 50]) for _ in range(rng.randint(0, 3000)))
        parts = bpe.chunks(text.encode())
        assert b"".join(parts) == text.encode()
        segments = [(h, None if m is None else words.encode(m), t) for h, m, t in (bpe.halves(p.decode()) for p in parts)]
        assert bpe.rejoined(words, segments) == words.encode(text)
    shared = "".join(f"w{rng.randint(0, 10**6)} " for _ in range(3000))
    a, b = bpe.chunks(("one " + shared).encode()), bpe.chunks(("another text first " + shared).encode())
    assert len(set(a) & set(b)) >= len(a) - 2


def test_another_tokenizer(spark, odd_docs, odd_rows):
    """One that keeps white space: whole texts go through the library."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert wordbpe.splits_words(queries.tokenizer_path()) and not wordbpe.splits_words(path)
    library = Tokenizer.from_file(path)
    want = Counter()
    for i, text in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.ids, r.decoded) for r in bpe.decoded(bpe.encoded(odd_docs, path), path).collect()) == want


def plain_top(rows, k, scale=256):
    whole = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]) for i, v in rows
             if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in whole:
        if q % 2 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_top_k_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 1.0, 0.1]) for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (202, []), (204, [1.0, None, 0.0, 0.0]), (206, [float("nan")] * 4), (208, [float("inf")] * 4),
             (None, [1.0] * 4), (210, [1.0, 2.0]), (212, [2.0, 1.0]), (214, [3.0]), rows[0]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS score", "2 AS block", "3 AS dim")
    for options in ({}, {"query_block": 7, "candidate_block": 11}, {"pivots_of": 1}):
        got = {}
        for r in topk.top_k(df, df.vec_id % 2 == 0, 5, **options).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        # row 0 is there twice: it has two answers, and takes two ranks in those of others
        want = {q: [(i, *pair) for i, pair in enumerate(v, 1) for _ in range(2 if q == 0 else 1)] for q, v in plain_top(rows, 5).items() if v}
        assert got == want
    assert topk.top_k(df.limit(0), df.vec_id % 2 == 0).count() == 0


def test_top_k_skips_far_groups(spark):
    """Clustered vectors: nearly all products are saved. Without clusters the results are as right, but little is saved."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 4
    for spread, least, most in ((0.05, 0.0, 0.2), (8.0, 0.2, 1.01)):
        vectors = centres[rng.integers(20, size=3000)] + rng.normal(size=(3000, 16)) * spread
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        options = {"query_block": 16, "candidate_block": 64, "pivots_of": 40}
        found = topk.found_pairs(df, df.vec_id % 50 == 0, 5, **options)
        evaluated = found.where("evaluated IS NOT NULL").selectExpr("sum(evaluated)").first()[0]
        assert least <= evaluated / (60 * 2999) < most
        whole = np.floor(256 * vectors)
        got = {}
        for r in topk.top_k(df, df.vec_id % 50 == 0, 5, **options).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        for q in range(0, 3000, 50):
            scores = (whole @ whole[q]).astype(int).tolist()
            best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:5]
            assert got[q] == {n: (i, -s) for n, (s, i) in enumerate(best, 1)}


def test_top_k_sends_no_blocks_through_the_driver(spark, monkeypatch):
    """What query blocks become, once for each cell that they meet, shows neither in the size of the table nor in that of stored rows."""
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(topk, "stored", seen)
    rng = np.random.default_rng(9)
    vectors = np.repeat(rng.normal(size=(60, 8)), 10, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    options = {"query_block": 16, "candidate_block": 32, "pivots_of": 4}
    found = topk.found_pairs(df, df.vec_id % 5 == 0, 5, **options)
    rows = found.collect()
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 5 and not any("Broadcast" in plan for plan in plans)
    # of equal vectors no more than k rows of a cell are kept
    assert max(Counter(r.query_id for r in rows if r.evaluated is None).values()) <= 5 * 4
    got = {}
    for r in topk.top_k(df, df.vec_id % 5 == 0, 5, **options).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    whole = np.floor(256 * vectors)
    for q in range(0, 600, 5):
        best = sorted((-s, i) for i, s in enumerate((whole @ whole[q]).astype(int).tolist()) if i != q)[:5]
        assert got[q] == {n: (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert len(got) == 120


def test_top_k_large_and_long_vectors(spark):
    """Numbers beyond single precision and beyond exact squares, and blocks that make several cells."""
    rng = np.random.default_rng(10)
    for size, cell in ((1.0, 64), (40.0, 64), (3e4, 2**22), (3e6, 64)):
        vectors = rng.normal(size=(300, 5)) * size
        vectors[:, 4] = 0 if size == 3e6 else vectors[:, 4]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(topk, "CELL_NUMBERS", cell)
            got = {}
            for r in topk.top_k(df, df.vec_id % 3 == 0, 4, scale=2.0, pivots_of=3, candidate_block=6, query_block=9).collect():
                got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        whole = np.floor(2 * vectors).astype(int).astype(object)
        for q in range(0, 300, 3):
            best = sorted((-s, i) for i, s in enumerate((whole @ whole[q]).tolist()) if i != q)[:4]
            assert got[q] == {n: (i, -s) for n, (s, i) in enumerate(best, 1)}


def test_narrow_vectors():
    rng = np.random.default_rng(11)
    for most, size in ((127, 1), (128, 2), (32767, 2), (40_000, 4), (2.0**40, 8)):
        whole = np.floor(rng.uniform(-most, most, (7, 3)))
        whole[2, 1] = -most
        packed, ids = topk.narrow(whole), np.arange(21).reshape(7, 3)
        assert packed.itemsize == size
        back = topk._arrays(pa.scalar(ids.tobytes()), pa.scalar(packed.tobytes()), 3)
        assert (back[0] == ids).all() and (back[1] == whole).all()
    pivots = np.floor(rng.normal(size=(9, 6)) * 200)
    for size in (200, 1e9):
        vectors = np.floor(rng.normal(size=(50, 6)) * size)
        assert np.allclose(topk.distances(vectors, pivots), np.linalg.norm(vectors[:, None] - pivots[None], axis=2), rtol=1e-12)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    vectors, queries, pivots = (np.floor(rng.normal(size=(n, 6)) * 200) for n in (300, 40, 9))
    far, q_far = topk.distances(vectors, pivots), topk.distances(queries, pivots)
    span = far.min(0), far.max(0), float((vectors**2).sum(1).max())
    assert (topk.group_bounds(queries, q_far, span) >= (queries @ vectors.T).max(1)).all()
    ids = np.arange(300)
    floors = np.sort(queries @ vectors.T, axis=1)[:, -7].astype(float)
    for i, found, scores, evaluated in topk.best_of(queries, q_far, vectors, far, ids, np.full(40, -1), 5, floors):
        want = queries[i] @ vectors.T
        assert sorted(scores, reverse=True)[:5] == sorted(want, reverse=True)[:5] and (scores == want[found]).all() and evaluated <= 300


def plain_components(rows, width, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().translate(neardup._LOWER).split()
        n = min(width, len(words))
        sets.append({tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set())
    key = [2**63 - 1 if i is None else i for i, _ in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]) or sets[a] and sets[b] and key[a] == key[b]:
                group[top(a)] = top(b)
    low = {}
    for x in range(len(rows)):
        low[top(x)] = min(low.get(top(x), 2**63), key[x])
    return sorted(((rows[x][0], len(sets[x]), None if low[top(x)] == 2**63 - 1 else low[top(x)]) for x in range(len(rows))), key=str)


@pytest.mark.parametrize("split", [False, True])
def test_near_duplicates(spark, odd_docs, odd_rows, no_docs, monkeypatch, split):
    """Also with buckets and groups dealt out in blocks."""
    if split:
        monkeypatch.setattr(neardup, "BUCKET_NODES", 5)
        monkeypatch.setattr(neardup, "GROUP_SHINGLES", 300)
    rng = random.Random(7)
    rows = [r for r in odd_rows if r[0] not in (17, 18, None)]
    base = [f"word{i}" for i in range(120)]
    for i in range(40):
        words = [w if rng.random() > 0.01 * (i % 9) else f"new{rng.random()}" for w in base]
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS node", "2 AS root", "3 AS kept")
    got = neardup.near_duplicates(df, width=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_components(rows, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(no_docs).count() == 0
    assert neardup.near_duplicates(odd_docs).count() == len(odd_rows)


@pytest.mark.parametrize("split", [False, True])
def test_near_duplicates_without_ids(spark, monkeypatch, split):
    """Rows without an id, and texts of a repeated one, are judged one by one."""
    if split:
        monkeypatch.setattr(neardup, "BUCKET_NODES", 2)
        monkeypatch.setattr(neardup, "GROUP_SHINGLES", 100)

    def text(name, changed=()):
        return " ".join(f"new{i}" if i in changed else f"{name}{i}" for i in range(100))

    rows = [(1, text("a")), (None, text("a", [3])), (None, text("b")), (None, text("c")), (None, text("c", [7])), (None, text("c", [90])),
            (None, text("d")), (None, text("d")), (None, None), (2, text("e")), (2, text("f")), (0, text("f", [5])), (3, text("g")), (3, text("g", [9]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()
    key = {r[0]: t for t, r in ((t, spark.sql("SELECT xxhash64(:t)", {"t": t or ""}).first()) for t in {t for _, t in rows})}
    assert sorted(((r.doc_id, key[r.text_key]) for r in got), key=str) == sorted(rows, key=str)

    def found(*texts):
        return [(r.doc_id, r.component_id, r.kept) for r in got if key[r.text_key] in texts]

    assert sorted(found(text("a"), text("a", [3])), key=str) == [(1, 1, True), (None, 1, False)]
    assert found(text("b")) == [(None, None, True)] and found(None) == [(None, None, True)]
    assert sorted(found(text("c"), text("c", [7]), text("c", [90])), key=str) == [(None, None, False)] * 2 + [(None, None, True)]
    assert found(text("d")) == [(None, None, True)] * 2  # equal rows
    assert found(text("e")) == [(2, 2, True)] and found(text("f")) == [(2, 0, False)] and found(text("f", [5])) == [(0, 0, True)]
    assert sorted(found(text("g"), text("g", [9]))) == [(3, 3, False), (3, 3, True)]


def test_estimate_is_close():
    rng = np.random.default_rng(8)
    multipliers, offsets = neardup.permutations(neardup.BANDS * neardup.ROWS)
    for share in (0.0, 0.3, 0.8, 1.0):
        found = []
        for _ in range(20):
            a = rng.integers(0, 2**63, 1000, np.uint64)
            cut = round(1000 * 2 * share / (1 + share))
            b = np.concatenate([a[:cut], rng.integers(0, 2**63, 1000 - cut, np.uint64)])
            one, two = (np.frombuffer(neardup.packed_bits(neardup.minima(x, multipliers, offsets), 4), np.uint8).reshape(4, -1) for x in (a, b))
            found.append(neardup.estimates(one, two[None], 200, 4)[0])
        assert abs(np.mean(found) - share) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 100), (7, 7)]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(1, 51)}, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
