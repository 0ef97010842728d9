"""Minute -> hour -> day rollups.

Every level takes mean, min and max of every numeric column of the level below, so a measure ``v``
becomes ``v_mean``, then ``v_mean_mean``, ``v_mean_min``, …; means of means are not weighted.

All aggregates have fixed-width buffers, so Spark plans hash aggregation with map-side partial
aggregation: a hot sensor reaches the shuffle as one row per map task and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake.constants import NON_MEASURES, STATS
from gaugelake.functions import naming as N
from gaugelake.functions.timing import instant

SENSOR_KEYS = ("sensor_name", "asset_id")
LONG_KEYS = ("sensor_name", "asset_id", "measure")
_NOT_ROLLED = ("kafka_timestamp", "arrival_order", "ingest_batch")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns that are rolled up: numeric by type, booleans are not."""
    skip = {*exclude, *NON_MEASURES, *_NOT_ROLLED}
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def stat_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns of a rollup; anything named like a timestamp is left out."""
    return [c for c in numeric_columns(df, exclude) if "timestamp" not in c.lower()]


def stat_aggregates(columns: Sequence[str]) -> list[Column]:
    """Mean, min and max of each column; NaN is skipped like NULL.

    Day rollups have many of these, so they are given as SQL text: one call per aggregate.
    """
    functions = {"mean": "avg", "min": "min", "max": "max"}
    return [
        F.expr(f"{functions[s]}(nanvl(double({N.quote(c)}), double(null))) AS {N.quote(N.stat_name(c, s))}")
        for c in columns for s in STATS
    ]


def _with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(" AND ".join(f"{N.quote(key)} IS NOT NULL" for key in keys))


def minute_of(time_col: str) -> Column:
    """The minute of a time, by whole numbers; ``date_trunc`` would build a calendar time for each row and measure."""
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(60_000_000)))


def minute_rollup(
    rows: DataFrame,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = SENSOR_KEYS,
    time_col: str = "event_time",
    order_col: str = "arrival_order",
) -> DataFrame:
    """Rows -> one row per (minute, keys); ``timestamp_first`` is the first to arrive.

    Rows without any number are not counted in.
    """
    columns = list(columns) if columns is not None else numeric_columns(rows, keys)
    measured = _with_keys(rows, keys).where(
        F.coalesce(*[F.col(N.quote(c)).cast("double") for c in columns]).isNotNull()
    )
    return measured.groupBy(
        minute_of(time_col).alias("minute_bucket"), *keys
    ).agg(
        *stat_aggregates(columns),
        F.min_by(time_col, order_col).alias("timestamp_first"),
    )


def hour_rollup(minutes: DataFrame, keys: Sequence[str] = SENSOR_KEYS) -> DataFrame:
    return _next_level(
        minutes, keys, "minute_bucket", F.date_trunc("hour", "minute_bucket").alias("hour_bucket")
    )


def day_rollup(hours: DataFrame, keys: Sequence[str] = SENSOR_KEYS) -> DataFrame:
    return _next_level(hours, keys, "hour_bucket", F.to_date("hour_bucket").alias("day_bucket"))


def _next_level(df: DataFrame, keys: Sequence[str], below: str, bucket: Column) -> DataFrame:
    columns = stat_columns(df, keys)
    return _with_keys(df, keys).groupBy(bucket, *keys).agg(
        *stat_aggregates(columns), F.min(below).alias(f"{below}_first")
    )


def in_hour(minutes: DataFrame, target: datetime, column: str = "minute_bucket") -> DataFrame:
    """The full hour of ``target``. Cut rows before rolling them up: buckets are computed, a range on them stays above the scan."""
    start = instant(target.replace(minute=0, second=0, microsecond=0))
    return minutes.where((F.col(column) >= start) & (F.col(column) < start + F.expr("INTERVAL 1 HOUR")))


def in_day(hours: DataFrame, target: date, column: str = "hour_bucket") -> DataFrame:
    start = instant(target)
    return hours.where((F.col(column) >= start) & (F.col(column) < start + F.expr("INTERVAL 1 DAY")))


def cascade(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = SENSOR_KEYS) -> DataFrame:
    """Rows to days in two shuffles.

    The minute level shuffles partial aggregates on its full key. Its result has at most 1440 rows
    per key and day, so it can be placed by (keys, date) whatever the skew of the rows; that
    placement serves the hour and the day level, which need no shuffle of their own.
    """
    minutes = minute_rollup(rows, columns, keys)
    placed = minutes.withColumn("event_date", F.to_date("minute_bucket")).repartition(*keys, "event_date")
    hours = hour_rollup(placed, (*keys, "event_date"))
    days = _with_keys(hours, keys).groupBy(*keys, "event_date").agg(
        *stat_aggregates(stat_columns(hours, (*keys, "event_date"))),
        F.min("hour_bucket").alias("hour_bucket_first"),
    )
    return days.withColumnRenamed("event_date", "day_bucket")


def text_buckets(rollup: DataFrame) -> DataFrame:
    """Compat view: bucket columns as the text labels of the file layout."""
    labels = {
        "minute_bucket": "yyyy-MM-dd'T'HH:mm:00",
        "hour_bucket": "yyyy-MM-dd HH:00:00",
        "day_bucket": "yyyy-MM-dd",
    }
    for name, pattern in labels.items():
        for column in (name, f"{name}_first"):
            if column in rollup.columns:
                fmt = labels["minute_bucket"] if name == "minute_bucket" else pattern
                rollup = rollup.withColumn(column, F.date_format(column, fmt))
    return rollup


def parse_bucket(bucket: Column) -> Column:
    """Text bucket label of any level -> TIMESTAMP, NULL when unreadable."""
    return bucket.try_cast("timestamp")


def pivot_measures(rollup: DataFrame, measures: Sequence[str], keys: Sequence[str] = SENSOR_KEYS) -> DataFrame:
    """Long rollup (one row per measure, columns ``value_*``) -> wide, for the listed measures."""
    buckets = [c for c in ("minute_bucket", "hour_bucket", "day_bucket") if c in rollup.columns]
    stats = [c for c in rollup.columns if c.startswith("value_")]
    firsts = [c for c in rollup.columns if c.endswith("_first")]
    return rollup.where(F.col("measure").isin(*measures)).groupBy(*buckets, *keys).agg(
        *[
            F.max(F.when(F.col("measure") == m, F.col(c))).alias(m + c.removeprefix("value"))
            for m in measures for c in stats
        ],
        *[F.min(c).alias(c) for c in firsts],
    )
