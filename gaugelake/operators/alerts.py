"""Alert rules over the metrics table: one plan for all of them.

A rule compares a gauge, or the rate of a counter over a trailing window, with a limit and fires when the
comparison has held for a time. Samples are reduced to steps first (the last value and the increase inside a
step), so a series has as many rows as steps, however many samples came.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.operators.monitor import SERIES

STEP_S = 60
MICROS = 1_000_000


class AlertRule(NamedTuple):
    """Fires where ``metric`` (``window_s``: its increase per second over that time) is ``sign`` ``limit`` for ``hold_s``."""

    name: str
    metric: str
    sign: str  # ">", "<" or "="
    limit: float
    hold_s: int
    window_s: int | None = None
    severity: str = "warning"


# Limits and times of the rules.
RULES = (
    AlertRule("consumer_lag", "consumer_lag", ">", 10_000, 600),
    AlertRule("no_messages", "messages_consumed_total", "=", 0, 900, 300),
    AlertRule("disk_usage", "storage_usage", ">", 0.85, 300),
    AlertRule("write_failures", "storage_write_failures_total", ">", 0.1, 300, 300, "critical"),
    AlertRule("open_state", "buffer_size_bytes", ">", 500_000_000, 300),
    AlertRule("upload_failures", "upload_failures_total", ">", 0.05, 600, 600),
    AlertRule("upload_backlog", "files_pending_upload", ">", 1000, 1800),
    AlertRule("upload_errors", "upload_connection_errors_total", ">", 0, 300, None, "critical"),
    AlertRule("cleanup_failures", "cleanup_failures_total", ">", 0, 3600, 3600),
    AlertRule("rollup_delay", "rollup_delay_seconds", ">", 7200, 600),
    AlertRule("rollup_failures", "rollup_failures_total", ">", 0, 1800, 3600),
)


def steps(metrics: DataFrame, by: Sequence[str] = SERIES, step_s: int = STEP_S) -> DataFrame:
    """``by``, ``at`` (start of the step, epoch seconds), ``value`` (the last), ``increase`` since the step before.

    A counter that falls has started anew from zero. NULL and NaN samples do not count; samples of a series
    have distinct times.
    """
    seconds = F.unix_micros("ts")
    at = (F.floor(seconds / (step_s * MICROS)) * step_s).cast("bigint")
    kept = metrics.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*by, "ts", "value", at.alias("at"))
    inside = Window.partitionBy(*by, "at").orderBy("ts")
    before = F.lag("value").over(inside)
    grown = kept.withColumn("grown", _growth(before, F.col("value")))
    reduced = grown.groupBy(*by, "at").agg(
        F.sum("grown").alias("inner"), F.min_by("value", "ts").alias("first"),
        F.max_by("value", "ts").alias("value"))
    last = F.lag("value").over(Window.partitionBy(*by).orderBy("at"))
    return reduced.select(*by, "at", "value", (F.coalesce("inner", F.lit(0.0)) + F.coalesce(_growth(last, F.col("first")), F.lit(0.0))).alias("increase"))


def _growth(before: Column, after: Column) -> Column:
    return F.when(after >= before, after - before).when(after < before, after)


def fired(metrics: DataFrame, rules: Sequence[AlertRule] = RULES, by: Sequence[str] = SERIES, step_s: int = STEP_S,
          max_gap_s: int = 300) -> DataFrame:
    """One row for each time a rule held for its ``hold_s``: rule, severity, ``by``, ``held_from``, ``held_until``, ``held_seconds``, ``peak``.

    Rules are rows of a small table that series meet by metric name, so the samples are read once for all
    rules. A step at which the comparison fails, or more than ``max_gap_s`` without samples, ends a hold.
    """
    spark = metrics.sparkSession
    known = spark.createDataFrame(
        [(r.name, r.severity, r.metric, r.sign, float(r.limit), r.hold_s, r.window_s) for r in rules],
        "rule string, severity string, name string, sign string, `limit` double, hold_s bigint, window_s bigint")
    wanted = metrics.where(F.col("name").isin(sorted({r.metric for r in rules})))
    series = steps(wanted, by, step_s)
    for window in sorted({r.window_s for r in rules if r.window_s}):
        trailing = Window.partitionBy(*by).orderBy("at").rangeBetween(step_s - window, 0)
        series = series.withColumn(f"rate_{window}", F.sum("increase").over(trailing) / F.lit(float(window)))
    measure = F.col("value")
    for window in sorted({r.window_s for r in rules if r.window_s}):
        measure = F.when(F.col("window_s") == window, F.col(f"rate_{window}")).otherwise(measure)
    judged = series.join(F.broadcast(known), "name").withColumn("measure", measure)  # as many rows as rules
    holds = (F.when(F.col("sign") == ">", F.col("measure") > F.col("limit")).when(F.col("sign") == "<", F.col("measure") < F.col("limit"))
             .otherwise(F.col("measure") == F.col("limit")))
    order = Window.partitionBy("rule", *by).orderBy("at")
    marked = judged.withColumn("holds", holds)
    goes_on = F.lag("holds").over(order) & (F.col("at") - F.lag("at").over(order) <= max_gap_s)
    marked = marked.withColumn("starts", (F.col("holds") & ~F.coalesce(goes_on, F.lit(False))).cast("int"))
    numbered = marked.withColumn("hold", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("holds")
    held = numbered.groupBy("rule", "severity", *by, "hold", "hold_s", "sign").agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.max("measure").alias("most"), F.min("measure").alias("least"))
    return held.where(F.col("high") - F.col("low") >= F.col("hold_s")).select(
        "rule", "severity", *by, F.timestamp_seconds("low").alias("held_from"), F.timestamp_seconds("high").alias("held_until"),
        (F.col("high") - F.col("low")).alias("held_seconds"), F.when(F.col("sign") == "<", F.col("least")).otherwise(F.col("most")).alias("peak"))
