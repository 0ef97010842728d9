"""Compaction of raw hours that hold many small files.

Folders of small files of an hour are packed into bins of about ``TARGET_BYTES``, and each bin becomes one
file of a new batch. The swap is one entry in the ledger: before it readers pass over the new batch, after it
over the folders that the batch replaces. These are deleted afterwards; a run that breaks off is finished by
the next one. The mirror copies the new batch and then retires the copies of what it replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake.operators import filejobs as J
from gaugelake.plans import ledger, tiers
from gaugelake.plans.refresh import RAW_SCHEMA, hour_folders, table_path
from gaugelake.sources import lake

TARGET_BYTES = 128 * 1024 * 1024
#: Folders of files below this share of the target are packed together.
SMALL = 0.5
#: Only folders of this form are compacted, not those of a table with extra partitions.
_BATCH_FOLDER = r"^event_date=[^/]+/event_hour=[^/]+/ingest_batch=[^/]+$"


def bins(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``hour``, ``folder``, ``bin`` for folders of small files, where that makes fewer files.

    ``files`` have ``folder`` and ``size``. Folders of an hour are taken by size, the largest first, and
    fill bins one after the other.
    """
    folders = files.where(F.col("folder").rlike(_BATCH_FOLDER)).groupBy("folder").agg(
        F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.count("*").alias("files"))
    small = folders.where(F.col("largest") < int(SMALL * target_bytes)).withColumn("hour", F.substring_index("folder", "/", 2))
    before = F.sum("bytes").over(W.partitionBy("hour").orderBy(F.desc("bytes"), "folder").rowsBetween(W.unboundedPreceding, -1))
    packed = small.withColumn("bin", F.floor(F.coalesce(before, F.lit(0)) / F.lit(target_bytes)).cast("int"))
    worth = packed.groupBy("hour").agg(F.sum("files").alias("n"), F.countDistinct("bin").alias("made")).where("made < n").select("hour")
    return packed.join(worth, "hour", "left_semi").select("hour", "folder", "bin")


def compact(spark: SparkSession, root: str, before: datetime, hours: Sequence[datetime] | None = None,
            target_bytes: int = TARGET_BYTES, **write_options) -> int:
    """Compact the hours that were over at ``before`` (all of the ledger, or those given); returns the replaced folders' number.

    Hours that wait for a refresh are left alone. Run one compaction of a lake at a time.
    """
    _finish(spark, root)
    hour = F.concat_ws(" ", "event_date", "event_hour")
    entries = ledger.landed(spark, root).select("event_date", "event_hour", hour.alias("hour"))
    waiting = ledger.unrefreshed(spark, root).select(hour.alias("hour"))
    closed = entries.where(F.col("hour") < before.strftime("%Y-%m-%d %H")).join(waiting, "hour", "left_anti").select("hour").distinct().collect()
    chosen = {datetime.strptime(r["hour"], "%Y-%m-%d %H") for r in closed}
    if hours is not None:
        chosen &= {h.replace(minute=0, second=0, microsecond=0) for h in hours}
    folders = hour_folders(chosen)
    if not folders:
        return 0
    files = tiers.both_tiers(spark, root, None, "raw", folders).where("live")
    plan = J.snapshot(bins(files, target_bytes), "compaction")
    n = plan.count()
    if not n:
        return 0
    batch = f"{tiers.COMPACTED}{uuid.uuid4().hex}"
    path = table_path(root, "raw")
    # as many folders as the rows are read from
    small = [r["folder"] for r in plan.select("folder").collect()]
    rows = spark.read.schema(RAW_SCHEMA).option("basePath", path).parquet(*[f"{path}/{f}" for f in small])
    own = plan.select("bin", *[F.regexp_extract("folder", f"{name}=([^/]*)", 1).alias(name) for name in ledger.KEYS])
    binned = rows.join(own.withColumn("ingest_batch", F.try_url_decode("ingest_batch")), list(ledger.KEYS)).withColumn("ingest_batch", F.lit(batch))
    placed = binned.repartition("event_date", "event_hour", "bin").sortWithinPartitions("event_date", "event_hour", "asset_id", "sensor_name", "event_time")
    placed.select(*RAW_SCHEMA.fieldNames()).write.mode("append").option("compression", lake.codec(write_options.get("compression", "lz4"))).partitionBy(
        *ledger.KEYS).parquet(path)
    # the swap: one file of entries, there or not
    ledger.append(plan.select("folder", F.lit(batch).alias("by")), root, "replaced")
    _finish(spark, root)
    return n


def _finish(spark: SparkSession, root: str) -> None:
    """Delete what a finished compaction has replaced and what a broken one has written."""
    if not lake.exists(spark, table_path(root, "raw")):
        return
    replaced = ledger.read(spark, root, "replaced")
    hours = replaced.select(F.substring_index("folder", "/", 2).alias("hour")).distinct()
    known = [r["hour"] for r in hours.collect() if lake.exists(spark, f"{table_path(root, 'raw')}/{r['hour']}")]
    if known:
        files = lake.list_files(spark, table_path(root, "raw"), below=known).withColumn("folder", tiers.folder_of(F.col("rel_path")))
        gone = files.join(replaced.select("folder").distinct(), "folder", "left_semi").select("rel_path", "size")
        J.run_delete(gone, table_path(root, "raw"), dry_run=False)


def sweep(spark: SparkSession, root: str) -> int:
    """Delete batches of compactions that broke off before their swap; lists the whole raw table. Returns the files' number."""
    files = lake.list_files(spark, table_path(root, "raw")).withColumn("folder", tiers.folder_of(F.col("rel_path")))
    batch = tiers.batch_of(F.col("folder"))
    finished = ledger.read(spark, root, "replaced").select(F.col("by").alias("batch")).distinct()
    broken = files.where(batch.startswith(tiers.COMPACTED)).withColumn("batch", batch).join(finished, "batch", "left_anti")
    return J.run_delete(broken.select("rel_path", "size"), table_path(root, "raw"), dry_run=False).count()
