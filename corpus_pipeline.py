"""A text corpus from raw documents to packed sequences.

Five stages, each over all that the one before kept:

1. quality rules: documents that fail one go;
2. MinHash near-dedup: the document with the smallest id stays of each group, once;
3. suffix-array dedup: passages that a document with a smaller id has too are cut out of the text;
4. secret scan: found secrets are replaced by their kind;
5. best-fit packing: pieces of the texts, with their token ids (little-endian unsigned 32-bit), and their places in sequences.

Stages 1 to 4 return the columns of their input in its order; ``n_chars``, where there is one, follows
the text. A NULL text is empty and goes in stage 1; a document whose text is cut out whole stays, empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.llm import neardup, packing, quality, secretscan, suffixes
from gaugelake.llm.queries import tokenizer_path
from gaugelake.llm.shared import importable, stored

#: SQL has no MinHash, suffix array or BPE; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None

#: Names that the stages add for a while; no table is expected to use this prefix.
OWN = "__p_"


def _with_text(df: DataFrame, docs: DataFrame, text: F.Column) -> DataFrame:
    """The columns of ``docs``, with ``text`` in place of theirs and ``n_chars`` fitting it."""
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judged(docs, prefix=OWN)
    return judged.filter(F.col(f"{OWN}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8. Of rows with equal id and text one stays."""
    id_, key = docs["doc_id"], F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    judged = neardup.near_duplicates(docs, width=5, percent=80)
    marks = judged.groupBy(F.col("doc_id").alias(f"{OWN}id"), F.col("text_key").alias(f"{OWN}key")).agg(
        F.bool_or(~F.col("kept")).alias(f"{OWN}gone"), (F.count("*") > 1).alias(f"{OWN}again")).filter(f"{OWN}gone OR {OWN}again")
    marked = docs.join(marks, id_.eqNullSafe(marks[f"{OWN}id"]) & (key == marks[f"{OWN}key"]), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = marked.filter(F.col(f"{OWN}id").isNull() & F.col(f"{OWN}key").isNull()).select(*columns)
    again = marked.filter(~F.col(f"{OWN}gone")).dropDuplicates(["doc_id", "text"]).select(*columns)
    return alone.unionByName(again)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes; only whole characters are cut, so that texts stay valid."""
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    cut = suffixes.without_repeats(docs, width=50, whole_characters=True, carry=others)
    cut = cut.select(*[F.col(f"carried.`{c}`").alias(c) for c in others], F.col("kept").alias(f"{OWN}kept"))
    return _with_text(cut, docs, F.decode(F.col(f"{OWN}kept"), "utf-8"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = secretscan.scanned(docs, prefix=OWN)
    return _with_text(scanned, docs, F.col(f"{OWN}redacted"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # places are found without the ids, which move once, to their places
    row = f"{OWN}row"
    pieces = stored(packing.pieces(docs, tokenizer_path(), with_ids=True).withColumn(row, F.monotonically_increasing_id()), "pieces")
    places = packing.packed(pieces.drop("ids")).select(row, "sequence_id", "offset")
    return pieces.join(places, row).drop(row)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(importable(spark), docs, sf_dir), name)
    return docs
