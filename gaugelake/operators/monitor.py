"""Monitoring questions over raw rows and a ``metrics(ts, name, labels, series, value)`` table.

A series is a name with one set of labels; ``series`` is the labels as text, which can be grouped by.

Series can be hot, so rows are first reduced to time steps (with map-side partial aggregation);
windows over a series then see a number of rows bounded by the time span, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake.constants import (
    LAG_LIMIT, RATE_WINDOW, RATE_WINDOW_S, ROLLUP_DELAY_S, SILENCE_AFTER_S, STALE_AFTER_S, USAGE_LIMIT,
)
from gaugelake.functions.timing import instant


def _seconds(ts: Column) -> Column:
    """Whole and fractional epoch seconds as DOUBLE."""
    return F.unix_micros(ts) / F.lit(1_000_000.0)


def _step(time_col: str, width: str) -> Column:
    return F.window(F.col(time_col), width)["start"]


def as_metrics(report: DataFrame, ts: datetime | Column, labels: Sequence[str] = ()) -> DataFrame:
    """A report as rows of the metrics table: one per report row and numeric column."""
    at = ts if isinstance(ts, Column) else instant(ts)
    pairs = [x for name in labels for x in (F.lit(name), F.col(name).cast("string"))]
    label_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    values = [
        F.struct(F.lit(f.name).alias("name"), F.col(f.name).cast("double").alias("value"))
        for f in report.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in labels
    ]
    written = [F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in sorted(labels)]
    return report.select(
        at.alias("ts"), label_map.alias("labels"), F.concat_ws(",", *written).alias("series"), F.inline(F.array(*values))
    ).select("ts", "name", "labels", "series", "value")


SERIES = ("name", "series")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append samples to a metrics table by date."""
    metrics.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).write.mode("append").partitionBy("date").parquet(path)


def message_rate(rows: DataFrame, by: Sequence[str], time_col: str, window: str = RATE_WINDOW,
                 window_s: int = RATE_WINDOW_S) -> DataFrame:
    """Messages per second in tumbling windows."""
    return rows.groupBy(*by, _step(time_col, window).alias("window_start")).agg(
        F.count("*").alias("messages"), (F.count("*") / F.lit(float(window_s))).alias("rate")
    )


def counter_rate(metrics: DataFrame, by: Sequence[str] = SERIES, window: str = RATE_WINDOW,
                 window_s: int = RATE_WINDOW_S, grain: str = "10 seconds") -> DataFrame:
    """Per-second increase of counters in tumbling windows; a drop is a reset to zero.

    The increase is the sum of the steps between neighbouring samples of a window. It is computed in
    two levels: between samples inside a grain, then between the grains of a window. A window
    therefore never gathers all samples of a series in one task, only those of one grain.
    """
    grained = metrics.where(F.col("value").isNotNull()).select(
        *by, "ts", "value", _step("ts", window).alias("window_start")
    ).select("*", _step("ts", grain).alias("_grain"))
    inside = Window.partitionBy(*by, "window_start", "_grain").orderBy("ts")
    per_grain = grained.withColumn("_prev", F.lag("value").over(inside)).groupBy(
        *by, "window_start", "_grain"
    ).agg(
        F.sum(_increase("_prev", "value")).alias("_inner"),
        F.min_by("value", "ts").alias("_first"),
        F.max_by("value", "ts").alias("_last"),
        F.count("*").alias("_samples"),
    )
    across = Window.partitionBy(*by, "window_start").orderBy("_grain")
    joined = per_grain.withColumn("_prev_last", F.lag("_last").over(across))
    increase = F.sum(F.coalesce("_inner", F.lit(0.0)) + F.coalesce(_increase("_prev_last", "_first"), F.lit(0.0)))
    return joined.groupBy(*by, "window_start").agg(
        F.sum("_samples").alias("samples"),
        increase.alias("increase"),
    ).withColumn("rate", F.col("increase") / F.lit(float(window_s)))


def _increase(before: str, after: str) -> Column:
    b, a = F.col(before), F.col(after)
    return F.when(b.isNotNull(), F.when(a >= b, a - b).otherwise(a)).cast("double")


def failure_rate(rows: DataFrame, failed: Column, by: Sequence[str], time_col: str, limit: float = 0.0,
                 window: str = RATE_WINDOW, window_s: int = RATE_WINDOW_S) -> DataFrame:
    """Failures per second and their share per window; ``breach`` above the limit."""
    return rows.groupBy(*by, _step(time_col, window).alias("window_start")).agg(
        F.count("*").alias("total"),
        F.count_if(failed).alias("failures"),
    ).select(
        "*",
        (F.col("failures") / F.lit(float(window_s))).alias("failure_rate"),
        (F.col("failures") / F.col("total")).alias("failure_share"),
        (F.col("failures") / F.lit(float(window_s)) > limit).alias("breach"),
    )


def consumer_lag(latest: DataFrame, committed: DataFrame, limit: int = LAG_LIMIT) -> DataFrame:
    """Newest offset of the source minus newest offset landed, per (topic, partition).

    Offsets count from 0, so a partition nothing was read from lags by all its messages.
    """
    keys = ["topic", "partition"]
    head = latest.groupBy(*keys).agg(F.max("offset").alias("latest_offset"))
    done = committed.groupBy(*keys).agg(F.max("offset").alias("committed_offset"))
    lag = F.col("latest_offset") - F.col("committed_offset")
    return head.join(done, keys, "left").withColumn(
        "committed_offset", F.coalesce("committed_offset", F.lit(-1).cast("bigint"))
    ).select(*keys, "latest_offset", "committed_offset", lag.alias("lag"), (lag > limit).alias("breach"))


def silences(rows: DataFrame, by: Sequence[str], time_col: str, until: datetime,
             step: str = RATE_WINDOW, step_s: int = RATE_WINDOW_S, min_silence_s: int = SILENCE_AFTER_S,
             expected: DataFrame | None = None, since: datetime | None = None) -> DataFrame:
    """Stretches of empty windows, at least ``min_silence_s`` long, up to ``until``; later rows do not count.

    Series of ``expected`` (columns ``by``) without any row are silent from ``since`` on. Only windows with messages are kept and compared with their successor; the empty ones between
    them need not be generated.
    """
    rows = rows.where(F.col(time_col) < instant(until, rows.schema[time_col].dataType.simpleString()))
    active = rows.groupBy(*by, _step(time_col, step).alias("_start")).agg(F.count("*").alias("_n"))
    end = F.col("_start") + F.make_dt_interval(secs=F.lit(step_s))
    following = F.lead("_start", 1).over(Window.partitionBy(*by).orderBy("_start"))
    gaps = active.select(*by, end.alias("gap_start"), F.coalesce(following, instant(until)).alias("gap_end"))
    if expected is not None:
        if since is None:
            raise ValueError("expected series need a time since when they are expected")
        unseen = expected.select(*by).distinct().join(active.select(*by).distinct(), list(by), "left_anti")
        gaps = gaps.unionByName(unseen.select(*by, instant(since).alias("gap_start"), instant(until).alias("gap_end")))
    length = (F.unix_micros("gap_end") - F.unix_micros("gap_start")) / F.lit(1_000_000.0)
    return gaps.withColumn("gap_seconds", length).where(F.col("gap_seconds") >= min_silence_s)


def usage_ratio(used: DataFrame, capacity: DataFrame, by: Sequence[str], limit: float = USAGE_LIMIT) -> DataFrame:
    """Used bytes against capacity per key; used sizes are summed first."""
    total = used.groupBy(*by).agg(F.sum("size").alias("used_bytes"))
    ratio = F.col("used_bytes") / F.col("capacity_bytes")
    return total.join(capacity, list(by)).where(F.col("capacity_bytes") > 0).select(
        *by, "used_bytes", "capacity_bytes", ratio.alias("usage"), (ratio > limit).alias("breach")
    )


def held_thresholds(metrics: DataFrame, limit: float, hold_s: int, by: Sequence[str] = SERIES,
                    step: str = "1 minute", step_s: int = 60, max_gap_s: int = 300) -> DataFrame:
    """Periods in which a metric stayed above ``limit`` for at least ``hold_s``.

    The metric is read once per step, at its last sample. A step at or below the limit, or more than
    ``max_gap_s`` without samples, ends a period.
    """
    last = metrics.where(F.col("value").isNotNull()).groupBy(*by, _step("ts", step).alias("_at")).agg(
        F.max_by("value", "ts").alias("_value")
    )
    series = Window.partitionBy(*by).orderBy("_at")
    above = F.col("_value") > limit
    gap = F.unix_seconds("_at") - F.unix_seconds(F.lag("_at").over(series))
    carries_on = (F.lag("_value").over(series) > limit) & (gap <= max_gap_s)
    marked = last.select(
        *by, "_at", "_value", (above & ~F.coalesce(carries_on, F.lit(False))).cast("int").alias("_starts")
    )
    numbered = marked.withColumn(
        "_period", F.sum("_starts").over(series.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    periods = numbered.where(above).groupBy(*by, "_period").agg(
        F.min("_at").alias("held_from"), F.max("_at").alias("held_until"),
        F.count("*").alias("steps"), F.max("_value").alias("peak"),
    )
    held = (F.unix_seconds("held_until") - F.unix_seconds("held_from")).cast("bigint")
    return periods.select(*by, "held_from", "held_until", held.alias("held_seconds"), "steps", "peak").where(
        F.col("held_seconds") >= hold_s
    )


def rollup_delay(rollup: DataFrame, now: datetime, by: Sequence[str], bucket: str = "hour_bucket",
                 limit_s: int = ROLLUP_DELAY_S) -> DataFrame:
    """Age of the newest bucket."""
    newest = rollup.groupBy(*by).agg(F.max(bucket).alias("last_bucket"))
    delay = _seconds(instant(now)) - _seconds(F.col("last_bucket"))
    return newest.select(*by, "last_bucket", delay.alias("delay_seconds"), (delay > limit_s).alias("breach"))


def last_values(metrics: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Latest non-null value of each series (samples of a series have distinct times)."""
    return metrics.where(F.col("value").isNotNull()).groupBy(*by).agg(
        F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("last_value")
    )


def stale_sources(rows: DataFrame, now: datetime, by: Sequence[str], time_col: str,
                  after_s: int = STALE_AFTER_S) -> DataFrame:
    """Sources whose newest message is older than the limit."""
    newest = rows.groupBy(*by).agg(F.max(time_col).alias("last_message"))
    age = _seconds(instant(now)) - _seconds(F.col("last_message"))
    return newest.select(*by, "last_message", age.alias("age_seconds")).where(F.col("age_seconds") > after_s)


def ingest_counters(decoded: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Consumed and failed messages and the time of the last consumed one."""
    ok = F.col("text").isNotNull()
    return decoded.groupBy(*by).agg(
        F.count_if(ok).alias("messages_consumed"),
        F.count_if(~ok).alias("messages_failed"),
        F.max(F.when(ok, F.col("ingest_ts"))).alias("last_message_time"),
    )


def health(rows: DataFrame, now: datetime, asset_col: str, sensor_col: str, time_col: str, bad: Column,
           stale_after_s: int = STALE_AFTER_S, max_bad_share: float = 0.0) -> DataFrame:
    """Per asset: healthy when every sensor is; issues name what is wrong.

    A sensor is stale when nothing came for ``stale_after_s``, failing when the share of bad
    messages exceeds the limit.
    """
    sensors = rows.groupBy(asset_col, sensor_col).agg(
        F.max(time_col).alias("_last"), F.count("*").alias("_n"), F.count_if(bad).alias("_bad")
    )
    stale = _seconds(instant(now)) - _seconds(F.col("_last")) > stale_after_s
    failing = F.col("_bad") / F.col("_n") > max_bad_share
    judged = sensors.select(asset_col, stale.alias("_stale"), failing.alias("_failing"))
    any_stale, any_failing = F.bool_or("_stale"), F.bool_or("_failing")
    return judged.groupBy(asset_col).agg(
        F.count("*").alias("sensors"),
        F.count_if(F.col("_stale")).alias("stale_sensors"),
        F.count_if(F.col("_failing")).alias("failing_sensors"),
        F.bool_and(~F.col("_stale") & ~F.col("_failing")).alias("healthy"),
        F.concat_ws(
            ",", F.when(any_failing, F.lit("failing")), F.when(any_stale, F.lit("stale"))
        ).alias("issues"),
    )
