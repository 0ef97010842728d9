"""Operator 11."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelake.llm import fillmiddle as FM
from gaugelake.llm import queries

TOKENS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def plainly(doc_id, text, percent=50, units="tokens"):
    """The transformation over code points, spelled out."""
    text = text or ""
    tokens = re.findall(TOKENS, text) if units == "tokens" else list(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def random_text(rng):
    pieces = ["a", "word", " ", "  ", "\n", "\t\x0b", "é", "日本", "😀", "\x00", "\x85", "\xa0", " ", "<", ">", "<P", "S>", "<M>"]
    return "".join(rng.choices(pieces, [9] * (len(pieces) - 1) + [1], k=rng.randint(0, 30)))


@pytest.mark.parametrize("units", FM.UNITS)
def test_random_texts_against_code_points(units):
    rng = random.Random(11)
    forms = set()
    for doc_id in range(4000):
        text = random_text(rng)
        got = FM.transform(text.encode(), f"42:{doc_id}", 50, 80, units)
        assert (*got[:4], got.output.decode()) == plainly(doc_id, text, units=units), (doc_id, text)
        forms.add(got.form)
    assert forms == {"plain", "spm", "psm"}


def test_exceptions_convert_every_cut():
    rng = random.Random(5)
    for _ in range(300):
        text = random_text(rng)
        data = text.encode()
        index = FM.Exceptions(np.frombuffer(data, np.uint8))
        characters = np.arange(len(text) + 1)
        byte_cuts = np.array([len(text[:i].encode()) for i in characters])
        assert (index.to_bytes(characters) == byte_cuts).all()
        assert (index.to_characters(byte_cuts) == characters).all()
        assert index.n_characters == len(text)
        assert len(index.bytes) == sum(ord(c) > 127 for c in text)


def rows_of(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize("percent, units", [(50, "tokens"), (100, "tokens"), (100, "characters")])
def test_odd_rows(spark, odd_rows, odd_docs, percent, units):
    out = FM.transformed(odd_docs, percent=percent, units=units)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output",
                     FM.restored(F.col("output"), F.col("form")).alias("restored"))
    want = [(i, *plainly(i, t, percent, units), t or "") for i, t in odd_rows]
    assert rows_of(got) == sorted([*map(tuple, want)], key=lambda r: str(spark_row(got, r)))
    assert out.columns[:len(odd_docs.columns)] == odd_docs.columns


def spark_row(df, values):
    from pyspark.sql import Row

    return Row(*df.columns)(*values)


def test_clashing_names_and_no_rows(spark, odd_docs, no_docs):
    clash = odd_docs.selectExpr("*", "'x' AS form", "1 AS n", "'y' AS output")
    out = FM.transformed(clash, prefix="fim_")
    assert out.columns[-5:] == ["fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output"]
    assert out.where("fim_output IS NULL OR form <> 'x'").count() == 0 and out.count() == odd_docs.count()
    assert FM.transformed(no_docs).collect() == []


def test_long_text_and_other_markers(spark):
    text = "é " * 300_000 + "end"
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id bigint, text string")
    markers = FM.Markers("<PRE>", "<SUF>", "<MID>")
    out = FM.transformed(docs, percent=100, markers=markers)
    rows = out.select("n", "form", "prefix_chars", "middle_chars", "output",
                      (FM.restored(F.col("output"), F.col("form"), markers) == F.col("text")).alias("same")).collect()
    for r in rows:
        assert r.n == 300_001 and r.same and r.output.count("<MID>") == 1
        assert len(r.output) == len(text) + 15
    with pytest.raises(ValueError):
        FM.transformed(docs, markers=FM.Markers("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        FM.transformed(docs, units="lines")


def test_query(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.QUERIES["op11_fill_in_middle"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n, form, prefix, middle, output = plainly(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
