"""Incremental pulls from a table by timestamp, and their rows as keyed messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.constants import TOPIC_PREFIX
from gaugelake.functions import naming as N
from gaugelake.functions.timing import instant


PULL_PARTITIONS = 16
FETCH_ROWS = 10_000


def capped_query(table: str, max_rows: int, ts_col: str = "timestamp", high_water: datetime | None = None,
                 until: datetime | None = None) -> str:
    """The oldest ``max_rows`` rows and those tied with the last, as a query that the database answers."""
    bounds = [f"{ts_col} {sign} TIMESTAMP '{at.isoformat(sep=' ')}'" for sign, at in ((">", high_water), ("<=", until)) if at]
    where = f" WHERE {' AND '.join(bounds)}" if bounds else ""
    return f"(SELECT * FROM {table}{where} ORDER BY {ts_col} FETCH FIRST {int(max_rows)} ROWS WITH TIES) AS capped"


def bounds_query(table: str, ts_col: str = "timestamp", high_water: datetime | None = None) -> str:
    """Oldest and newest timestamp after ``high_water``, as a query that the database answers."""
    where = f" WHERE {ts_col} > TIMESTAMP '{high_water.isoformat(sep=' ')}'" if high_water else ""
    return f"(SELECT MIN({ts_col}) AS low, MAX({ts_col}) AS high FROM {table}{where}) AS bounds"


def jdbc_options(
    url: str,
    table: str,
    ts_col: str = "timestamp",
    high_water: datetime | None = None,
    until: datetime | None = None,
    partitions: int = PULL_PARTITIONS,
    max_rows: int | None = None,
    **extra: str,
) -> dict[str, str]:
    """Options of the ``jdbc`` source.

    With a known range the pull is split on the timestamp, so that no single task reads it all; a capped
    pull is small and is one query. The predicate itself is added by ``pulled`` and pushed down by Spark.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(FETCH_ROWS), **extra}
    if max_rows is not None:
        options["dbtable"] = capped_query(table, max_rows, ts_col, high_water, until)
    elif partitions > 1 and high_water is not None and until is not None:
        options |= {
            "partitionColumn": ts_col,
            "lowerBound": high_water.isoformat(sep=" "),
            "upperBound": until.isoformat(sep=" "),
            "numPartitions": str(partitions),
        }
    return options


def jdbc_pull(
    spark: SparkSession, url: str, table: str, ts_col: str = "timestamp",
    high_water: datetime | None = None, until: datetime | None = None,
    partitions: int = PULL_PARTITIONS, max_rows: int | None = None, **extra: str,
) -> DataFrame:
    options = jdbc_options(url, table, ts_col, high_water, until, partitions, max_rows, **extra)
    return pulled(spark.read.format("jdbc").options(**options).load(), ts_col, high_water, until)


def pulled(
    table: DataFrame, ts_col: str = "timestamp",
    high_water: datetime | None = None, until: datetime | None = None,
) -> DataFrame:
    """Rows newer than ``high_water`` (all rows without one)."""
    kind = table.schema[ts_col].dataType.simpleString()
    if high_water is not None:
        table = table.where(F.col(ts_col) > instant(high_water, kind))
    if until is not None:
        table = table.where(F.col(ts_col) <= instant(until, kind))
    return table


def next_high_water(rows: DataFrame, ts_col: str = "timestamp", high_water: datetime | None = None) -> DataFrame:
    """One row: where the next pull starts, in UTC; unchanged when nothing came."""
    newest = F.max(ts_col).cast("timestamp_ntz")
    if high_water is not None:
        newest = F.coalesce(newest, instant(high_water, "timestamp_ntz"))
    return rows.agg(newest.alias("high_water"), F.count("*").alias("rows"))


def capped(rows: DataFrame, ts_col: str = "timestamp", max_rows: int = 1000) -> DataFrame:
    """The oldest ``max_rows`` rows, and all rows tied with the last of them.

    Keeping ties whole makes the newest timestamp a safe high-water mark. The cut-off comes from a
    top-n (each task keeps n rows), so the table is never sorted as a whole.
    """
    oldest = rows.select(ts_col).orderBy(ts_col).limit(max_rows)
    cutoff = oldest.agg(F.max(ts_col).alias("cutoff")).scalar()
    return rows.where(F.col(ts_col) <= cutoff)


def as_messages(rows: DataFrame, key_col: str, name: Column, prefix: str = TOPIC_PREFIX) -> DataFrame:
    """Rows as messages: topic from ``name``, key from a value field, the row as JSON value."""
    return rows.select(
        N.topic_name(name, prefix).alias("topic"),
        F.col(key_col).cast("string").alias("key"),
        F.to_json(F.struct(*rows.columns)).alias("value"),
    )


def unkeyed(messages: DataFrame) -> DataFrame:
    """Rows that could not be keyed, for the error log; the pull itself goes on."""
    return messages.where(F.col("key").isNull())
