"""Column expressions and helpers for names, keys, paths and units."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugelake.constants import (
    BYTES_PER_MB, TOPIC_PREFIX, UNKNOWN_TABLE,
)


def sensor_name(topic: Column) -> Column:
    """What follows the prefix anywhere in the topic, else the topic itself."""
    found = F.regexp_extract(topic, f"{TOPIC_PREFIX}(.+)", 1)
    return F.when(found != "", found).otherwise(topic)


def table_name(topic: Column) -> Column:
    """The topic without its prefix, if it starts with it; every occurrence is removed."""
    return F.when(
        topic.startswith(TOPIC_PREFIX), F.replace(topic, F.lit(TOPIC_PREFIX), F.lit(""))
    ).otherwise(F.lit(UNKNOWN_TABLE))


def topic_name(name: Column, prefix: str = TOPIC_PREFIX) -> Column:
    return F.concat(F.lit(prefix), name.cast("string"))


def arrival_order(partition: Column, offset: Column) -> Column:
    """(partition, offset) packed into one BIGINT, ordered like the pair.

    A struct would do too, but a fixed-width ordering keeps ``min_by`` in hash aggregation;
    with a struct Spark sorts every map partition first.
    """
    return F.shiftleft(partition.cast("bigint"), 48) + offset.cast("bigint")


def calendar_keys(event_time: Column) -> list[Column]:
    return [
        F.date_format(event_time, "yyyy").alias("year"),
        F.date_format(event_time, "MM").alias("month"),
        F.date_format(event_time, "dd").alias("day"),
        F.date_format(event_time, "HH").alias("hour"),
    ]


def group_key(asset: Column, event_time: Column, table: Column) -> Column:
    return F.concat_ws("/", asset, F.date_format(event_time, "yyyy/MM/dd/HH"), table)


def raw_file_path(asset: Column, event_time: Column, table: Column, root: str = "") -> Column:
    name = F.concat(table, F.lit("_"), F.date_format(event_time, "yyyyMMdd_HH"), F.lit(".parquet"))
    path = F.concat_ws("/", asset, F.date_format(event_time, "yyyy/MM/dd/HH"), name)
    return F.concat(F.lit(root.rstrip("/") + "/"), path) if root else path


def rollup_file_path(asset: Column, bucket: Column, sensor: Column, level: str) -> Column:
    """Relative path of a ``minute``, ``hour`` or ``day`` rollup file in the hierarchical layout."""
    top, dirs = {
        "minute": ("aggregated", "yyyy/MM/dd/HH"),
        "hour": ("aggregated", "yyyy/MM/dd"),
        "day": ("daily", "yyyy/MM"),
    }[level]
    return F.concat_ws(
        "/", F.lit(top), asset, F.date_format(bucket, dirs), F.concat(sensor, F.lit(f"_{level}.parquet"))
    )


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root`` with forward slashes; outside of it the base name."""
    prefix = root.rstrip("/") + "/"
    slashed = F.translate(path, "\\", "/")
    return F.when(slashed.startswith(prefix), F.substr(slashed, F.lit(len(prefix) + 1))).otherwise(
        F.regexp_extract(slashed, "[^/]*$", 0)
    )


def strip_level_suffix(stem: Column) -> Column:
    """``x_minute`` / ``x_hour`` / ``x_day`` -> ``x``; only at the end, so such sensors keep their name."""
    return F.regexp_replace(stem, "_(minute|hour|day)$", "")


def stat_name(column: str, stat: str) -> str:
    return f"{column}_{stat}".strip("_")


def megabytes(size: Column) -> Column:
    return size / F.lit(float(BYTES_PER_MB))


def iso_text(event_time: Column) -> Column:
    """ISO 8601; fractional seconds only when there are any, then six digits."""
    micros = F.date_format(event_time, "SSSSSS")
    base = F.date_format(event_time, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def quote(name: str) -> str:
    return "`" + re.sub("`", "``", name) + "`"
