"""The incremental pull as a job that remembers where it stopped.

A pull takes the rows after the high-water mark up to the newest timestamp of that moment, split on the
timestamp, and then enters that timestamp as the new mark. Rows go to a partition named after the old mark:
a pull that breaks off before its mark is written is repeated into the same partition.
"""

from __future__ import annotations

from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.sources import incremental as I
from gaugelake.sources import lake

STATE = "source string, high_water timestamp_ntz, rows bigint, pulled_after string"
#: Name of the partition of a first pull.
START = "start"


class Source(Protocol):
    name: str
    ts_col: str

    def newest(self, spark: SparkSession, high_water: datetime | None) -> tuple[datetime, datetime] | None:
        """Oldest and newest timestamp after ``high_water``; None if nothing is there."""

    def rows(self, spark: SparkSession, high_water: datetime | None, bounds: tuple[datetime, datetime]) -> DataFrame:
        """The rows after ``high_water`` up to the newest."""


class StoredTable:
    """A table that Spark reads, as a function that opens it."""

    def __init__(self, name: str, open_table, ts_col: str = "timestamp"):
        self.name, self.open, self.ts_col = name, open_table, ts_col

    def newest(self, spark, high_water):
        found = I.pulled(self.open(spark), self.ts_col, high_water).agg(
            *[f(self.ts_col).cast("timestamp_ntz").alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]).first()
        return (found["low"], found["high"]) if found["high"] is not None else None

    def rows(self, spark, high_water, bounds):
        return I.pulled(self.open(spark), self.ts_col, high_water, bounds[1])


class JdbcTable:
    """A table of a database, which answers for its bounds itself; the pull is split between them."""

    def __init__(self, url: str, table: str, ts_col: str = "timestamp", partitions: int = I.PULL_PARTITIONS, **extra: str):
        self.name, self.url, self.table, self.ts_col, self.partitions, self.extra = table, url, table, ts_col, partitions, extra

    def newest(self, spark, high_water):
        query = I.bounds_query(self.table, self.ts_col, high_water)
        found = spark.read.format("jdbc").options(url=self.url, dbtable=query, **self.extra).load().select(
            *[F.col(n).cast("timestamp_ntz") for n in ("low", "high")]).first()
        return (found["low"], found["high"]) if found and found["high"] is not None else None

    def rows(self, spark, high_water, bounds):
        options = I.jdbc_options(self.url, self.table, self.ts_col, bounds[0], bounds[1], self.partitions, **self.extra)
        return I.pulled(spark.read.format("jdbc").options(**options).load(), self.ts_col, high_water, bounds[1])


def high_water(spark: SparkSession, state: str, source: str) -> datetime | None:
    """Where the next pull of a source starts; marks only rise."""
    if not lake.exists(spark, state):
        return None
    return spark.read.schema(STATE).parquet(state).where(F.col("source") == source).agg(F.max("high_water")).first()[0]


def pull(spark: SparkSession, source: Source, target: str, state: str) -> int:
    """Take what is new into ``target`` (partition ``pulled_after``) and remember it in ``state``; returns the number of rows.

    Rows whose timestamp is NULL are never taken, rows that come later with a timestamp up to the mark
    neither: that is what following a timestamp means. Run one pull of a source at a time.
    """
    mark = high_water(spark, state, source.name)
    bounds = source.newest(spark, mark)
    if bounds is None:
        return 0
    after = mark.strftime("%Y%m%dT%H%M%S.%f") if mark else START
    rows = source.rows(spark, mark, bounds).withColumn("pulled_after", F.lit(after))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pulled_after").parquet(target)
    n = lake.read_folders(spark, target, rows.schema, [f"pulled_after={after}"]).count()
    spark.createDataFrame([(source.name, bounds[1], n, after)], STATE).coalesce(1).write.mode("append").parquet(state)
    return n
