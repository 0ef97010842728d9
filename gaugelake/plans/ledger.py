"""What the engine knows about its own lake: small tables in a folder of their own.

    _engine/landed     one row per hour and ingest batch: files, rows, bytes, landed_on
    _engine/refreshed  hours and batches that rollups have taken in
    _engine/replaced   folders of raw/ that compaction has replaced, and by which

Neither the mirror nor the retention job touches this folder. Entries may repeat (a micro-batch that is
repeated writes its entry again), so readers take each key once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.operators.filejobs import snapshot
from gaugelake.sources import lake

KEYS = ("event_date", "event_hour", "ingest_batch")

SCHEMAS = {
    "landed": "event_date string, event_hour string, ingest_batch string, files bigint, rows bigint, bytes bigint, landed_on string",
    "refreshed": "event_date string, event_hour string, ingest_batch string",
    "replaced": "folder string, by string",
}


def place(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{lake.BOOKKEEPING}/{name}"


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A ledger; one that is not there yet is empty."""
    path = place(root, name)
    return spark.read.schema(SCHEMAS[name]).parquet(path) if lake.exists(spark, path) else spark.createDataFrame([], SCHEMAS[name])


def append(entries: DataFrame, root: str, name: str) -> None:
    columns = [part.split()[0] for part in SCHEMAS[name].split(", ")]
    entries.select(*columns).coalesce(1).write.mode("append").parquet(place(root, name))


def landed(spark: SparkSession, root: str) -> DataFrame:
    """Each hour and batch once, as its latest entry says."""
    return read(spark, root, "landed").groupBy(*KEYS).agg(
        *[F.max_by(c, "landed_on").alias(c) for c in ("files", "rows", "bytes")], F.max("landed_on").alias("landed_on"))


def entries_of(rows: DataFrame, landed_on: str) -> DataFrame:
    """Ledger entries of stored rows of the raw table; only file footers are read."""
    per_file = rows.groupBy(*KEYS, F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("rows"), F.max("_metadata.file_size").alias("size"))
    return per_file.groupBy(*KEYS).agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("size").alias("bytes")).withColumn("landed_on", F.lit(landed_on))


def rebuild(spark: SparkSession, root: str, now: datetime) -> None:
    """Enter every folder of ``raw/`` that the ledger does not have, for lakes that were filled otherwise.

    It lists all raw files. Their rows are not counted (NULL).
    """
    folder = F.regexp_extract("rel_path", r"^event_date=([^/]+)/event_hour=([^/]+)/(?:.*/)?ingest_batch=([^/]+)/[^/]*$", 0) != ""
    part = lambda i: F.regexp_extract("rel_path", r"^event_date=([^/]+)/event_hour=([^/]+)/(?:.*/)?ingest_batch=([^/]+)/[^/]*$", i)
    files = lake.list_files(spark, f"{root.rstrip('/')}/raw").where(folder)
    found = files.groupBy(part(1).alias(KEYS[0]), part(2).alias(KEYS[1]), F.url_decode(part(3)).alias(KEYS[2])).agg(
        F.count("*").alias("files"), F.lit(None).cast("bigint").alias("rows"), F.sum("size").alias("bytes"))
    missing = found.where(~F.startswith("ingest_batch", F.lit("compacted-"))).join(landed(spark, root).select(*KEYS), list(KEYS), "left_anti")
    append(missing.withColumn("landed_on", F.lit(now.strftime("%Y-%m-%d"))), root, "landed")


def unrefreshed(spark: SparkSession, root: str) -> DataFrame:
    """Hours and batches that landed since the last refresh of them, as they are now."""
    return snapshot(landed(spark, root).select(*KEYS).join(read(spark, root, "refreshed"), list(KEYS), "left_anti"), "unrefreshed")


def tidy(spark: SparkSession, root: str, names: Sequence[str] = tuple(SCHEMAS)) -> None:
    """Each ledger in one file; the old files go after the new one is there, so that readers see an entry twice but never not."""
    for name in names:
        path = place(root, name)
        if not lake.exists(spark, path):
            continue
        old = [f for f in lake.children(spark, path) if f.endswith(".parquet")]
        if len(old) < 2:
            continue
        whole = spark.read.schema(SCHEMAS[name]).parquet(*old)
        append(snapshot(whole.distinct(), name), root, name)
        lake.remove(spark, old)
