"""What the operators share: tables, the shared folder, row keys and block helpers."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the white space between words, as the body of a character class.
SPACES = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

MAX_ID = 2**63 - 1

WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> SparkSession:
    """Let local Python workers import this package wherever the driver was started.

    On a cluster the package is installed or passed with ``--py-files``.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where nothing is named (tests) it lies in the warehouse, which executors share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut.

    Shuffle files that led to it go as soon as it is written; Python workers get smaller batches.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key) for key in WHILE_WRITING}
    try:
        for key, value in WHILE_WRITING.items():
            spark.conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (BIGINT) and ``text`` alone; a NULL text is empty."""
    return df.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def sort_id(doc_id: str = "doc_id") -> Column:
    """The id for comparisons: rows without one come last."""
    return F.coalesce(F.col(doc_id), F.lit(MAX_ID))


def splits(df: DataFrame) -> int:
    """Shuffle width of the session, at least one."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` to be broadcast if it has at most so many rows, which are counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
