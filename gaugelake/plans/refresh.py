"""Lake tables and the batch job that keeps rollups in step with raw data.

Rollups are stored long, one row per measure, so any payload fits one schema:

    raw/     event_date, event_hour, ingest_batch
    minute/  event_date, event_hour     value_mean, value_min, value_max
    hour/    event_date, event_hour     9 statistics
    day/     event_date                 27 statistics

A refresh recomputes whole partitions and replaces them, so re-running it changes nothing and late
rows are picked up by refreshing the hours they belong to.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake.constants import STATS
from gaugelake.operators import flatten as FL
from gaugelake.operators import rollup as R
from gaugelake.plans import ledger, tiers
from gaugelake.sources import lake

LEVELS = ("hourly", "daily", "both")

def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _LONG, _DOUBLE, _TIME = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

RAW_SCHEMA = _schema(
    sensor_name=_TEXT, table_name=_TEXT, asset_id=_TEXT, event_time=_TIME, time_quality=_TEXT, topic=_TEXT,
    partition=T.IntegerType(), offset=_LONG, kafka_timestamp=_LONG, ingest_ts=_TIME, arrival_order=_LONG,
    measures=T.MapType(_TEXT, _DOUBLE), attrs=T.MapType(_TEXT, _TEXT),
    event_date=_TEXT, event_hour=_TEXT, ingest_batch=_TEXT,
)


def _stat_fields(depth: int) -> list[str]:
    names = ["value"]
    for _ in range(depth):
        names = [f"{n}_{s}" for n in names for s in STATS]
    return names


def _rollup_schema(bucket: str, bucket_type: T.DataType, first: str, depth: int, *partitions: str) -> T.StructType:
    return _schema(
        **{bucket: bucket_type},
        **dict.fromkeys(R.LONG_KEYS, _TEXT),
        **dict.fromkeys(_stat_fields(depth), _DOUBLE),
        **{first: _TIME},
        **dict.fromkeys(partitions, _TEXT),
    )


MINUTE_SCHEMA = _rollup_schema("minute_bucket", _TIME, "timestamp_first", 1, "event_date", "event_hour")
HOUR_SCHEMA = _rollup_schema("hour_bucket", _TIME, "minute_bucket_first", 2, "event_date", "event_hour")
DAY_SCHEMA = _rollup_schema("day_bucket", T.DateType(), "hour_bucket_first", 3, "event_date")

TABLES = {"raw": RAW_SCHEMA, "minute": MINUTE_SCHEMA, "hour": HOUR_SCHEMA, "day": DAY_SCHEMA}


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return lake.read_table(spark, table_path(root, name), TABLES[name])


def hour_folders(hours: Iterable[datetime]) -> list[str]:
    return sorted({h.strftime("event_date=%Y-%m-%d/event_hour=%H") for h in hours})


def hours_of(spark: SparkSession, root: str, name: str, hours: Iterable[datetime]) -> DataFrame:
    """These hours of a table; no other folder is listed."""
    return lake.read_folders(spark, table_path(root, name), TABLES[name], hour_folders(hours))


def touched_hours(raw: DataFrame) -> list[datetime]:
    """The hours rows fall into, for example those of the newest ingest batches.

    One entry per hour reaches the driver, however many rows there are.
    """
    found = raw.select("event_date", "event_hour").distinct().collect()
    return sorted(datetime.strptime(f"{r.event_date} {r.event_hour}", "%Y-%m-%d %H") for r in found)


def refresh_hours(spark: SparkSession, root: str, hours: Sequence[datetime], cold: str | None = None,
                  deleted: DataFrame | None = None, **write_options) -> None:
    """Recompute the minute and hour rollups of the given hours, all in one job per level."""
    raw = tiers.rows(spark, root, cold, "raw", RAW_SCHEMA, hour_folders(hours), deleted)
    minutes = R.minute_rollup(FL.explode_measures(raw), ["value"], R.LONG_KEYS)
    _store(minutes, root, "minute", "minute_bucket", **write_options)
    # read back what was written: the hour level then starts from a stored table
    stored = hours_of(spark, root, "minute", hours).drop("event_date", "event_hour")
    _store(R.hour_rollup(_rolled_on(stored), R.LONG_KEYS), root, "hour", "hour_bucket", **write_options)


def refresh_days(spark: SparkSession, root: str, days: Iterable[date], cold: str | None = None,
                 deleted: DataFrame | None = None, **write_options) -> None:
    """Recompute the day rollups of the given days from all their hours, also those that have expired."""
    folders = sorted({d.strftime("event_date=%Y-%m-%d") for d in days})
    hours = tiers.rows(spark, root, cold, "hour", HOUR_SCHEMA, folders, deleted).drop("event_date", "event_hour")
    _store(R.day_rollup(hours, R.LONG_KEYS), root, "day", "day_bucket", **write_options)


def refresh_rollups(
    spark: SparkSession, root: str, targets: datetime | Iterable[datetime], level: str = "both",
    cold: str | None = None, deleted: DataFrame | None = None, **write_options
) -> None:
    """Bring the rollups of the target hours (``hourly``), their days (``daily``) or both up to date.

    Where files expire, name the ``cold`` tier, so that hours and days are computed from all that ever
    landed, and the ``deleted`` files, so that what is incomplete is refused. See ``tiers.rows``.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    hours = [targets] if isinstance(targets, datetime) else list(targets)
    if not hours:
        return
    if level in ("hourly", "both"):
        refresh_hours(spark, root, hours, cold, deleted, **write_options)
    if level in ("daily", "both"):
        refresh_days(spark, root, [h.date() for h in hours], cold, deleted, **write_options)


def refresh_new(spark: SparkSession, root: str, level: str = "both", **options) -> list[datetime]:
    """Refresh the hours of everything that landed since the last such refresh; returns them.

    What landed is in the ledger; no raw file of other hours is opened or listed. The ledger of what is
    done is written last, so that a refresh that broke off is repeated.
    """
    todo = ledger.unrefreshed(spark, root)
    hours = touched_hours(todo)
    refresh_rollups(spark, root, hours, level, **options)
    if hours:
        ledger.append(todo, root, "refreshed")
    return hours


def _rolled_on(minutes: DataFrame) -> DataFrame:
    """Minute rows the hour level takes: measures named like a timestamp end here."""
    return minutes.where(~F.lower("measure").contains("timestamp"))


def _store(rollup: DataFrame, root: str, name: str, bucket: str, **write_options) -> None:
    parts = ("event_date",) if name == "day" else lake.TIME_PARTITIONS
    keyed = lake.with_time_partitions(rollup, bucket).select(*TABLES[name].fieldNames())
    lake.write_table(keyed, table_path(root, name), parts, sort_by=["asset_id", "sensor_name", "measure", bucket],
                     **write_options)
