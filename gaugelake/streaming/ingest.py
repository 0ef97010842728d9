"""Streaming ingest: messages to raw rows and rejects."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugelake.constants import RAW_FLUSH_AGE
from gaugelake.operators import flatten as FL
from gaugelake.operators import parse as P
from gaugelake.plans import ledger
from gaugelake.plans.refresh import RAW_SCHEMA, table_path
from gaugelake.sources import lake
from gaugelake.sources.kafka import drop_redelivered

Hook = Callable[[DataFrame], DataFrame]
#: Day of landing in the ledger, for rows without a time of ingestion.
LANDED_UNKNOWN = "1970-01-01"


def trigger_options(drain: bool = False, every: str = RAW_FLUSH_AGE) -> dict:
    """``drain`` takes everything there is and ends; otherwise files land at the given age."""
    return {"availableNow": True} if drain else {"processingTime": every}


def batch_name(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """``<query id>-<batch id>``: the same when a batch is repeated, different for every other stream.

    Spark keeps the query's id in its checkpoint; batch ids alone start at 0 in each.
    """
    query = json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
    return f"{query}-{batch_id}"


def raw_rows(messages: DataFrame, hook: Hook | None = None, **route_options) -> DataFrame:
    """Messages -> rows of the raw table, without its partition columns.

    ``hook`` is the user's own step; it sees accepted, routed rows and returns rows of that shape.
    """
    rows = P.routed_messages(messages, **route_options)
    return FL.flatten_maps(hook(rows) if hook else rows)


def land_rows(keyed: DataFrame, root: str, extra_partitions: Sequence[str] = (), **write_options) -> None:
    """Write rows of the raw table, all columns, to their own ``ingest_batch`` folders and enter these in the ledger.

    Written again, rows replace themselves, and the ledger's entry stays one. The rows are in place before
    the ledger says so.
    """
    spark, seen = keyed.sparkSession, Observation()
    # sets of plain columns: observed expressions are interpreted row by row
    folder = F.concat(F.lit("event_date="), "event_date", F.lit("/event_hour="), "event_hour")
    stamped = keyed.withColumn("_folder", folder).observe(
        seen, F.collect_set("_folder").alias("folders"), F.collect_set("ingest_batch").alias("batches"),
        F.max("ingest_ts").cast("date").cast("string").alias("landed_on")).drop("_folder")
    lake.write_table(
        stamped, table_path(root, "raw"), (*lake.TIME_PARTITIONS, *extra_partitions, "ingest_batch"),
        sort_by=[c for c in ("asset_id", "sensor_name", "event_time") if c not in extra_partitions], **write_options,
    )
    found = seen.get
    folders, batches = sorted(found["folders"] or ()), sorted(found["batches"] or ())
    if not folders:
        return
    written = lake.read_folders(spark, table_path(root, "raw"), RAW_SCHEMA, folders).where(F.col("ingest_batch").isin(batches))
    ledger.append(ledger.entries_of(written, found["landed_on"] or LANDED_UNKNOWN), root, "landed")


def start_ingest(
    messages: DataFrame,
    root: str,
    *,
    checkpoint: str,
    hook: Hook | None = None,
    drain: bool = False,
    every: str = RAW_FLUSH_AGE,
    name: str = "ingest",
    compression: str = "lz4",
    max_rows_per_file: int | None = None,
    extra_partitions: Sequence[str] = (),
    dedupe: str | None = None,
    **route_options,
) -> StreamingQuery:
    """Land a message stream in ``raw/`` and ``rejects/`` below ``root``.

    Each micro-batch writes its own ``ingest_batch`` partitions and replaces them when it is
    repeated, and offsets are committed after the write: rows land exactly once. Streams with other
    checkpoints, also later ones into the same ``root``, never touch them. Any lateness is accepted.
    With ``dedupe`` (a time such as ``"10 minutes"``) messages that the source delivers again, the same
    topic, partition and offset, land once if they come within that time of message time; state is kept
    that long. ``extra_partitions`` are columns of the raw table to partition by as well. Progress carries the counters ``messages_consumed``, ``messages_failed`` and
    ``last_message_time``.
    """
    options = {"compression": compression, "max_rows_per_file": max_rows_per_file}
    # the stream's clock is in its offset log: a repeated batch gets the same ingest_ts
    stamped = messages if "ingest_ts" in messages.columns else messages.withColumn("ingest_ts", F.current_timestamp())
    usable = F.try_validate_utf8(F.col("value").cast("string")).isNotNull()
    counted = stamped.observe(
        "ingest",
        F.count_if(usable).alias("messages_consumed"),
        F.count_if(~usable).alias("messages_failed"),
        F.max(F.when(usable, F.col("ingest_ts"))).alias("last_message_time"),
    )

    if dedupe is not None:
        counted = drop_redelivered(counted, dedupe)

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            name_of_batch = batch_name(batch.sparkSession, checkpoint, batch_id)
            rows = raw_rows(batch, hook, **route_options).withColumn("ingest_batch", F.lit(name_of_batch))
            keyed = lake.with_time_partitions(rows, "event_time").select(*RAW_SCHEMA.fieldNames())
            land_rows(keyed, root, extra_partitions, **options)
            refused = P.rejects(P.decode(batch)).select(
                "*", F.date_format("ingest_ts", "yyyy-MM-dd").alias("ingest_date"),
                F.lit(name_of_batch).alias("ingest_batch"),
            )
            lake.write_table(refused, table_path(root, "rejects"), ("ingest_date", "ingest_batch"), **options)
        finally:
            batch.unpersist()

    return (
        counted.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(drain, every))
        .foreachBatch(land)
        .start()
    )
