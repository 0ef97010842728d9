"""Windowed rollups of a message stream, with a watermark for late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugelake.constants import RAW_FLUSH_AGE
from gaugelake.functions import naming as N
from gaugelake.operators import rollup as R
from gaugelake.plans.refresh import table_path
from gaugelake.sources import lake
from gaugelake.streaming.ingest import batch_name, trigger_options


def minute_windows(
    rows: DataFrame, columns: Sequence[str] = ("value",), keys: Sequence[str] = R.LONG_KEYS,
    watermark: str | None = "10 minutes",
) -> DataFrame:
    """The minute rollup as a tumbling window: one row per (minute, keys) once the minute is closed."""
    measured = rows.where(F.coalesce(*[F.col(N.quote(c)).cast("double") for c in columns]).isNotNull())
    if watermark is not None:
        measured = measured.withWatermark("event_time", watermark)
    return measured.groupBy(F.window("event_time", "1 minute").alias("minute_window"), *keys).agg(
        *R.stat_aggregates(columns), F.min_by("event_time", "arrival_order").alias("timestamp_first")
    )


def hour_windows(minutes: DataFrame, keys: Sequence[str] = R.LONG_KEYS) -> DataFrame:
    return _chained(minutes, keys, "minute_window", "hour_window", "1 hour", "minute_bucket_first")


def day_windows(hours: DataFrame, keys: Sequence[str] = R.LONG_KEYS) -> DataFrame:
    return _chained(hours, keys, "hour_window", "day_window", "1 day", "hour_bucket_first")


def _chained(df: DataFrame, keys: Sequence[str], below: str, name: str, width: str, first: str) -> DataFrame:
    columns = R.stat_columns(df, keys)
    window: Column = F.window(F.col(below), width).alias(name)
    return df.groupBy(window, *keys).agg(
        *R.stat_aggregates(columns), F.min(F.col(f"{below}.start")).alias(first)
    )


def with_bucket(windows: DataFrame, level: str) -> DataFrame:
    """Window column -> bucket column, as in the batch rollups."""
    window, bucket = F.col(f"{level}_window.start"), f"{level}_bucket"
    start = F.to_date(window) if level == "day" else window
    return windows.select(start.alias(bucket), *[c for c in windows.columns if c != f"{level}_window"])


def latest_minutes(stored: DataFrame, keys: Sequence[str] = R.LONG_KEYS) -> DataFrame:
    """Rows that ``start_minute_rollup`` has landed, for each minute and key the one of the latest batch.

    Batches are compared as numbers, ``…-10`` is later than ``…-9``. Rows of several queries must not be
    mixed: their batches have no common order.
    """
    batch = F.regexp_extract("ingest_batch", r"(\d+)$", 1).cast("bigint")
    parts = ("minute_bucket", *keys)
    rest = [c for c in stored.columns if c not in (*parts, *lake.TIME_PARTITIONS, "ingest_batch")]
    newest = stored.groupBy(*parts).agg(F.max_by(F.struct(*rest), batch).alias("newest"))
    return newest.select(*parts, "newest.*")


def start_minute_rollup(
    rows: DataFrame, root: str, *, checkpoint: str, watermark: str = "10 minutes",
    output_mode: str = "append",
    drain: bool = False, every: str = RAW_FLUSH_AGE, name: str = "minute_live", **write_options,
) -> StreamingQuery:
    """Land closed minutes in ``minute_live/``; a repeated micro-batch replaces its own partitions.

    With ``output_mode="update"`` each trigger lands the minutes it has changed, closed or not; of
    several rows for a minute the one of the latest batch counts: read them with ``latest_minutes``.

    ``refresh_rollups`` owns ``minute/`` and also knows rows that came after the watermark.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        keyed = lake.with_time_partitions(batch, "minute_bucket").withColumn(
            "ingest_batch", F.lit(batch_name(batch.sparkSession, checkpoint, batch_id))
        )
        lake.write_table(
            keyed, table_path(root, name), (*lake.TIME_PARTITIONS, "ingest_batch"),
            sort_by=["asset_id", "sensor_name", "measure"], **write_options,
        )

    return (
        with_bucket(minute_windows(rows, watermark=watermark), "minute")
        .writeStream.queryName(name).outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(drain, every))
        .foreachBatch(land)
        .start()
    )
