"""Queries of the text operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.llm import bpe, divergence, fillmiddle, nbsvm, neardup, packing, quality, secretscan, sharding, suffixes, topk, urlrules, wordwindows
from gaugelake.llm.shared import importable, stored, table, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The rules of the URL query.
URL_RULES = [
    urlrules.rule_of("allow", "org/"),
    urlrules.rule_of("block", "example.org/es/"),
    urlrules.rule_of("block", "example.org/en/1"),
    urlrules.rule_of("allow", "com/fr/"),
    urlrules.rule_of("block", "com/de/"),
]


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(importable(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()), "pieces")
    return packing.packed(pieces)


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wordwindows.without_repeats(table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.without_repeats(table(spark, sf_dir, "documents"), width=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secretscan.scanned(texts(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", F.col("counts")[0].alias("n_assign"), F.col("counts")[1].alias("n_access"),
        F.col("counts")[2].alias("n_hex"), F.sha2(F.encode("base", "utf-8"), 256).alias("base_sha256"), "spans")


@query
def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    out = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), path), path)
    return stored(out.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256")), "bpe-digests")


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judged(pages, URL_RULES).drop("url")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(texts(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.failed_any(quality.BASE_RULES).alias("base_failed"), "kept")


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("text_key")


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fillmiddle.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "utf-8"), 256).alias("output_sha256"),
        F.sha2(F.encode(fillmiddle.restored(F.col("output"), F.col("form")), "utf-8"), 256).alias("restored_sha256"))


@query
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = nbsvm.scored(documents, nbsvm.train(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
