"""The query catalogue: one function per query, ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake.functions import naming as N
from gaugelake.functions import variants as V
from gaugelake.functions.timing import instant
from gaugelake.operators import alerts as A
from gaugelake.operators import flatten as FL
from gaugelake.operators import lifecycle as L
from gaugelake.operators import monitor as M
from gaugelake.operators import parse as P
from gaugelake.operators import rollup as R
from gaugelake.operators.union import union_by_name
from gaugelake.plans import jobs, ledger, tiers
from gaugelake.plans import views as W
from gaugelake.plans.refresh import DAY_SCHEMA, RAW_SCHEMA, refresh_new
from gaugelake.session import configure, shared_dir, with_shared_dir
from gaugelake.sources import incremental as I
from gaugelake.sources import kafka as K
from gaugelake.sources import lake
from gaugelake.streaming import windows as ST
from gaugelake.streaming.ingest import land_rows

Query = Callable[[SparkSession, str], DataFrame]

# Parameters the SQL checks repeat.
TOPICS = "^sensor-data-(view|click).*"
HIGH_WATER = datetime(2024, 1, 15)
PULL_ROWS = 1000
TARGET_HOUR = datetime(2024, 1, 10, 12)
TARGET_DAY = date(1998, 4, 1)
EVENTS_NOW = datetime(2024, 1, 31)
FILES_NOW = datetime(2001, 8, 1)
LISTING_PREFIX = "asset_1"
HELD_LIMIT = 40.0
HELD_SECONDS = 300
HELD_GAP_SECONDS = 3600
LAG_CUT = datetime(2024, 1, 20)
LAG_LIMIT = 3_500
ROLLUP_NOW = datetime(2024, 1, 30)
STALE_SECONDS = 21_600
LATE_SENSOR = "R"
ALERT_GAP_SECONDS = 10_800
ALERT_RULES = (
    A.AlertRule("high_value", "event_value", ">", 40, 3600, None, "critical"),
    A.AlertRule("low_value", "event_value", "<", 20, 5400),
    A.AlertRule("many_events", "events_total", ">", 0.05, 3600, 3600),
    A.AlertRule("few_events", "events_total", "<", 0.01, 7200, 7200),
    A.AlertRule("started_anew", "events_total", "=", 0, 0, 600),
    A.AlertRule("never", "no_such_metric", ">", 0, 0),
)

MEASURES = {"value": ["value"], "props_k": ["props", "k"]}

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query; instants leave it as plain UTC timestamps."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(configure(spark), sf_dir)
        return df.selectExpr(*[
            f"CAST({N.quote(f.name)} AS TIMESTAMP_NTZ) AS {N.quote(f.name)}"
            if f.dataType == T.TimestampType() else N.quote(f.name)
            for f in df.schema.fields
        ])

    QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """DOUBLE columns rounded, since sums of doubles depend on their order."""
    return df.selectExpr(*[
        f"round({N.quote(f.name)}, {digits}) AS {N.quote(f.name)}" if f.dataType == T.DoubleType() else N.quote(f.name)
        for f in df.schema.fields
    ])


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_messages(W.messages(spark, sf_dir))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.routed_messages(W.messages(spark, sf_dir))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.flatten_wide(routed(spark, sf_dir), MEASURES)


# Sources

@query
def src_topic_filter(spark, sf_dir):
    return K.subscribed(W.envelopes(spark, sf_dir), TOPICS).select("topic", "partition", "offset")


@query
def src_incremental_pull(spark, sf_dir):
    return I.pulled(W.table(spark, sf_dir, "events"), "ts", HIGH_WATER)


@query
def src_high_water(spark, sf_dir):
    return I.next_high_water(I.pulled(W.table(spark, sf_dir, "events"), "ts", HIGH_WATER), "ts", HIGH_WATER)


@query
def src_pull_capped(spark, sf_dir):
    return I.capped(I.pulled(W.table(spark, sf_dir, "events"), "ts", HIGH_WATER), "ts", PULL_ROWS)


@query
def src_pull_capped_ties(spark, sf_dir):
    items = W.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    return I.capped(items, "l_shipdate", PULL_ROWS)


@query
def src_key_extract(spark, sf_dir):
    rows = W.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return I.as_messages(rows, "user_id", F.col("event_type"))


# Parsing and layout

@query
def parse_envelope(spark, sf_dir):
    return P.accepted(parsed(spark, sf_dir)).select(
        "sensor_name", "topic", "partition", "offset", "ingest_ts",
        F.coalesce("kafka_timestamp", F.lit(-1).cast("bigint")).alias("kafka_timestamp"),
        "parse_status",
        F.regexp_extract(V.kind(F.col("data")), "^[A-Z]+", 0).alias("payload_kind"),
    )


@query
def parse_topic(spark, sf_dir):
    return W.envelopes(spark, sf_dir).select(
        "offset", N.sensor_name(F.col("topic")).alias("sensor_name"), N.table_name(F.col("topic")).alias("table_name")
    )


@query
def parse_event_time(spark, sf_dir):
    return routed(spark, sf_dir).select(
        "offset", "event_time", "time_quality", N.iso_text(F.col("event_time")).alias("iso_time")
    )


@query
def parse_event_time_source_clock(spark, sf_dir):
    rows = P.routed_messages(W.messages(spark, sf_dir), bucket_clock="source", numeric_time_unit="ns")
    return rows.select("offset", "event_time", "time_quality")


@query
def parse_asset(spark, sf_dir):
    return routed(spark, sf_dir).select("offset", "asset_id")


@query
def parse_raw_text(spark, sf_dir):
    rows = P.accepted(parsed(spark, sf_dir)).where(~V.is_object(V.kind(F.col("data"))) | (F.col("parse_status") == "raw_text"))
    return rows.select(
        "offset", "parse_status",
        F.when(F.col("parse_status") == "raw_text", V.as_text(V.field(F.col("data"), "value")))
        .otherwise(V.as_text(F.col("data"))).alias("value"),
    )


@query
def parse_rejects(spark, sf_dir):
    return P.rejects(P.decode(W.messages(spark, sf_dir))).groupBy("topic", "reason").agg(F.count("*").alias("rows"))


@query
def parse_status_counts(spark, sf_dir):
    return parsed(spark, sf_dir).groupBy("topic", "parse_status").agg(F.count("*").alias("rows"))


@query
def layout_keys(spark, sf_dir):
    rows = routed(spark, sf_dir).select(
        N.group_key(F.col("asset_id"), F.col("event_time"), F.col("table_name")).alias("group_key"),
        *N.calendar_keys(F.col("event_time")),
    )
    return rows.groupBy("group_key", "year", "month", "day", "hour").agg(F.count("*").alias("rows"))


@query
def layout_paths(spark, sf_dir):
    path = N.raw_file_path(F.col("asset_id"), F.col("event_time"), F.col("table_name"), "/data/raw")
    return routed(spark, sf_dir).groupBy(path.alias("file_path")).agg(F.count("*").alias("rows"))


@query
def layout_rollup_paths(spark, sf_dir):
    args = (F.col("asset_id"), F.date_trunc("minute", "event_time"), F.col("sensor_name"))
    paths = [N.rollup_file_path(*args, level).alias(f"{level}_path") for level in ("minute", "hour", "day")]
    return routed(spark, sf_dir).groupBy(*paths).agg(F.count("*").alias("rows"))


@query
def layout_relative_paths(spark, sf_dir):
    """Paths below the root and, for open orders, outside of it; file stems without level suffix."""
    root = F.when(F.col("o_orderstatus") == "O", "/elsewhere/").otherwise("/data/raw/")
    path = F.concat(root, F.lit("daily/asset_"), F.col("o_custkey").cast("string"), F.lit("/"),
                    F.col("o_orderkey").cast("string"), F.lit("_day"))
    return W.table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path")).select(
        "o_orderkey",
        N.relative_path(F.col("path"), "/data/raw").alias("rel_path"),
        N.strip_level_suffix(F.regexp_extract("path", "[^/]*$", 0)).alias("stem"),
    )


# Flattening

@query
def flatten_wide(spark, sf_dir):
    flat = FL.flatten_wide(routed(spark, sf_dir), MEASURES, {"daqid": ["daqid"]})
    return flat.select(
        "offset", "sensor_name", "asset_id", F.nanvl("value", F.lit(-1.0)).alias("value"), "props_k",
        F.coalesce("daqid", F.lit("")).alias("daqid"),
    )


@query
def flatten_collision(spark, sf_dir):
    """A payload field that takes the place of an envelope column where it is given."""
    flat = FL.flatten_wide(routed(spark, sf_dir), {}, {"topic": ["daqid"]}, on_collision="payload")
    return flat.select("offset", "topic", "sensor_name")


@query
def flatten_long(spark, sf_dir):
    long = FL.explode_measures(FL.flatten_maps(routed(spark, sf_dir)))
    return long.select("offset", "measure", F.nanvl("value", F.lit(-1.0)).alias("value"))


@query
def flatten_attributes(spark, sf_dir):
    flat = FL.flatten_maps(routed(spark, sf_dir))
    return flat.select("offset", F.explode("attrs").alias("attribute", "value"))


@query
def flatten_fields(spark, sf_dir):
    return FL.discover_fields(routed(spark, sf_dir))


# Rollups

@query
def agg_minute(spark, sf_dir):
    return rounded(R.minute_rollup(wide(spark, sf_dir), ["value"]))


@query
def agg_minute_multi(spark, sf_dir):
    return rounded(R.minute_rollup(W.samples(spark, sf_dir), W.SAMPLE_MEASURES))


@query
def agg_minute_long(spark, sf_dir):
    long = FL.explode_measures(FL.flatten_maps(routed(spark, sf_dir)))
    # epoch milliseconds are among the measures: at 6 digits they would leave the exact doubles
    return rounded(R.minute_rollup(long, ["value"], R.LONG_KEYS), 3)


@query
def agg_hour(spark, sf_dir):
    return rounded(R.hour_rollup(R.minute_rollup(wide(spark, sf_dir), ["value"])))


@query
def agg_hour_target(spark, sf_dir):
    rows = R.in_hour(wide(spark, sf_dir), TARGET_HOUR, "event_time")
    return rounded(R.hour_rollup(R.minute_rollup(rows, ["value"])))


@query
def agg_hour_multi(spark, sf_dir):
    return rounded(R.hour_rollup(R.minute_rollup(W.samples(spark, sf_dir), W.SAMPLE_MEASURES)))


@query
def agg_day(spark, sf_dir):
    return rounded(R.day_rollup(R.hour_rollup(R.minute_rollup(wide(spark, sf_dir), ["value"]))))


@query
def agg_day_target(spark, sf_dir):
    rows = R.in_day(W.samples(spark, sf_dir), TARGET_DAY, "event_time")
    return rounded(R.day_rollup(R.hour_rollup(R.minute_rollup(rows, ["quantity"]))))


@query
def agg_cascade(spark, sf_dir):
    return rounded(R.cascade(wide(spark, sf_dir), list(MEASURES)))


@query
def agg_cascade_sensor(spark, sf_dir):
    """Assets left out: few hot keys with many rows per bucket.

    Means over 32 and more values end in a 5 at the seventh digit, where the order of summation
    would decide the rounding; hence eight digits.
    """
    return rounded(R.cascade(wide(spark, sf_dir), list(MEASURES), keys=("sensor_name",)), 8)


@query
def agg_refresh_late(spark, sf_dir):
    """The day level of a lake whose files have expired when a sensor's rows come late.

    All other rows land, are rolled up, mirrored and deleted from the hot tier; then the late ones land and
    their hours and days are refreshed from both tiers.
    """
    place = f"{shared_dir(with_shared_dir(spark))}/agg-refresh-late-{uuid.uuid4().hex}"
    root, cold, log = (f"{place}/{name}" for name in ("hot", "cold", "log"))
    rows = W.sample_rows(spark, sf_dir).withColumn("ingest_batch", F.when(F.col("sensor_name") == LATE_SENSOR, "late").otherwise("on_time"))
    rows = lake.with_time_partitions(rows, "event_time").select(*RAW_SCHEMA.fieldNames())
    land_rows(rows.where("ingest_batch = 'on_time'"), root)
    refresh_new(spark, root)
    jobs.mirror(spark, root, cold, log)
    jobs.expire(spark, root, log, datetime.now(timezone.utc).replace(tzinfo=None) + timedelta(days=365), dry_run=False)
    land_rows(rows.where("ingest_batch = 'late'"), root)
    gone = L.gone(jobs.read_log(spark, log))
    refresh_new(spark, root, cold=cold, deleted=gone)
    dates = [r["event_date"] for r in ledger.landed(spark, root).select("event_date").distinct().collect()]
    days = tiers.rows(spark, root, cold, "day", DAY_SCHEMA, [f"event_date={d}" for d in dates], gone)
    return rounded(R.pivot_measures(days, list(W.SAMPLE_MEASURES)))


@query
def agg_pivot_wide(spark, sf_dir):
    """The long rollup turned wide for chosen measures."""
    long = FL.explode_measures(FL.flatten_maps(routed(spark, sf_dir)))
    minutes = R.minute_rollup(long, ["value"], R.LONG_KEYS)
    return rounded(R.pivot_measures(minutes, list(MEASURES)).drop("timestamp_first"))


@query
def agg_text_buckets(spark, sf_dir):
    hours = R.hour_rollup(R.minute_rollup(wide(spark, sf_dir), ["value"]))
    return R.text_buckets(hours).select(
        "sensor_name", "asset_id", "hour_bucket", "minute_bucket_first",
        R.parse_bucket(F.col("hour_bucket")).alias("parsed"),
    )


@query
def agg_minute_windows(spark, sf_dir):
    """The streaming form of the minute rollup over the stored messages."""
    minutes = ST.minute_windows(wide(spark, sf_dir), ["value"], R.SENSOR_KEYS, watermark=None)
    return rounded(ST.with_bucket(minutes, "minute"))


@query
def agg_day_windows(spark, sf_dir):
    """Chained windows, minute to hour to day."""
    minutes = ST.minute_windows(wide(spark, sf_dir), ["value"], R.SENSOR_KEYS, watermark=None)
    days = ST.day_windows(ST.hour_windows(minutes, R.SENSOR_KEYS), R.SENSOR_KEYS)
    return rounded(ST.with_bucket(days, "day"))


@query
def set_union_schema(spark, sf_dir):
    """Two schema versions of the events: whole values with ``k``, and fractions with the type."""
    source = W.table(spark, sf_dir, "events")
    older = source.where(F.col("event_type").isin("error", "signup")).select(
        "event_id", F.floor("value").cast("bigint").alias("value"), F.from_json("props", W.EVENT_KEY)["k"].alias("k")
    )
    newer = source.where(~F.col("event_type").isin("error", "signup")).select("event_id", "value", "event_type")
    both = union_by_name(older, newer)
    return both.select(
        "event_id", "value", F.coalesce("k", F.lit(-1)).alias("k"), F.coalesce("event_type", F.lit("")).alias("event_type")
    )


# Ingest

@query
def ingest_group_sizes(spark, sf_dir):
    key = N.group_key(F.col("asset_id"), F.col("event_time"), F.col("table_name"))
    groups = routed(spark, sf_dir).groupBy(key.alias("group_key")).agg(F.count("*").alias("rows"))
    return groups.agg(
        F.count("*").alias("group_count"), F.sum("rows").alias("buffered_records"), F.max("rows").alias("largest_group")
    )


@query
def ingest_dedup(spark, sf_dir):
    """Every message delivered twice, kept once."""
    once = W.envelopes(spark, sf_dir).select("topic", "partition", "offset")
    kept = K.drop_redelivered(once.unionByName(once))
    return kept.groupBy("topic", "partition").agg(F.count("*").alias("rows"), F.max("offset").alias("last_offset"))


# Lifecycle

@query
def life_list_prefix(spark, sf_dir):
    files = lake.with_prefix(L.listing(W.manifest_remote(spark, sf_dir)), LISTING_PREFIX)
    return rounded(L.listing_totals(files))


@query
def life_list_files(spark, sf_dir):
    return rounded(lake.with_prefix(L.listing(W.manifest_remote(spark, sf_dir)), LISTING_PREFIX))


@query
def life_storage_stats(spark, sf_dir):
    return rounded(L.storage_stats(lake.manifest_parts(W.manifest_local(spark, sf_dir))))


@query
def life_sync_plan(spark, sf_dir):
    return L.sync_plan(W.manifest_local(spark, sf_dir), W.manifest_remote(spark, sf_dir))


@query
def life_sync_summary(spark, sf_dir):
    plan = L.sync_plan(W.manifest_local(spark, sf_dir), W.manifest_remote(spark, sf_dir))
    return rounded(L.sync_summary(L.planned_results(plan, instant(FILES_NOW))))


@query
def life_uploaded_set(spark, sf_dir):
    return L.uploaded_set(W.upload_log(spark, sf_dir))


@query
def life_backlog(spark, sf_dir):
    pending = lake.manifest_parts(L.backlog(W.manifest_local(spark, sf_dir), W.upload_log(spark, sf_dir)))
    return L.backlog_report(pending, by=("asset_id",))


@query
def life_backlog_total(spark, sf_dir):
    return L.backlog_report(L.backlog(W.manifest_local(spark, sf_dir), W.upload_log(spark, sf_dir)))


def _eligible(spark, sf_dir):
    return L.cleanup_eligible(W.manifest_local(spark, sf_dir), W.upload_log(spark, sf_dir), FILES_NOW)


@query
def life_cleanup_eligible(spark, sf_dir):
    return _eligible(spark, sf_dir)


@query
def life_cleanup_dry_run(spark, sf_dir):
    return rounded(L.dry_run(_eligible(spark, sf_dir)))


@query
def life_cleanup_report(spark, sf_dir):
    """Outcome of deleting every eligible file."""
    return L.cleanup_report(_eligible(spark, sf_dir).withColumn("status", F.lit("deleted")))


# Monitoring

@query
def mon_rate_5m(spark, sf_dir):
    return rounded(M.message_rate(W.envelopes(spark, sf_dir), ["topic"], "timestamp"))


@query
def mon_counter_rate(spark, sf_dir):
    return rounded(M.counter_rate(W.counters(spark, sf_dir), window="1 hour", window_s=3600))


@query
def mon_failure_rate(spark, sf_dir):
    return rounded(M.failure_rate(
        P.decode(W.messages(spark, sf_dir)), F.col("text").isNull(), ["topic"], "ingest_ts", limit=0.0,
        window="1 hour", window_s=3600,
    ))


@query
def mon_lag(spark, sf_dir):
    head = W.envelopes(spark, sf_dir).select("topic", "partition", "offset", "ingest_ts")
    return M.consumer_lag(head, head.where(F.col("ingest_ts") <= instant(LAG_CUT)), LAG_LIMIT)


@query
def mon_gaps(spark, sf_dir):
    return M.silences(W.envelopes(spark, sf_dir), ["topic"], "timestamp", EVENTS_NOW)


@query
def mon_usage_ratio(spark, sf_dir):
    used = lake.manifest_parts(W.manifest_local(spark, sf_dir))
    quota = W.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("asset_"), F.col("c_custkey").cast("string")).alias("asset_id"),
        (F.round("c_acctbal") * 1000).cast("bigint").alias("capacity_bytes"),
    )
    return rounded(M.usage_ratio(used, quota, ["asset_id"]))


@query
def mon_threshold_for(spark, sf_dir):
    return rounded(M.held_thresholds(
        W.metrics(spark, sf_dir), HELD_LIMIT, HELD_SECONDS, max_gap_s=HELD_GAP_SECONDS
    ))


@query
def mon_alerts(spark, sf_dir):
    """Rules over a gauge and the rate of a counter, all in one plan."""
    samples = W.metrics(spark, sf_dir).unionByName(W.counters(spark, sf_dir))
    return rounded(A.fired(samples, ALERT_RULES, max_gap_s=ALERT_GAP_SECONDS))


@query
def mon_rollup_delay(spark, sf_dir):
    hours = R.hour_rollup(R.minute_rollup(wide(spark, sf_dir), ["value"]))
    return rounded(M.rollup_delay(hours, ROLLUP_NOW, ["sensor_name", "asset_id"]))


@query
def mon_last_value(spark, sf_dir):
    return rounded(M.last_values(W.metrics(spark, sf_dir)))


@query
def mon_stale(spark, sf_dir):
    return rounded(M.stale_sources(W.envelopes(spark, sf_dir), EVENTS_NOW, ["topic", "partition"], "timestamp"))


@query
def mon_ingest_counters(spark, sf_dir):
    return M.ingest_counters(P.decode(W.messages(spark, sf_dir)))


@query
def mon_health(spark, sf_dir):
    rows = W.messages(spark, sf_dir).select(
        F.col("key").cast("string").alias("asset"), "topic", "timestamp", F.col("value").isNull().alias("bad")
    )
    return M.health(rows, EVENTS_NOW, "asset", "topic", "timestamp", F.col("bad"), STALE_SECONDS)


@query
def mon_snapshot(spark, sf_dir):
    """Ingest counters as rows of the metrics table."""
    report = M.ingest_counters(P.decode(W.messages(spark, sf_dir)))
    rows = M.as_metrics(report, EVENTS_NOW, ["topic"])
    return rows.select("ts", "name", rows["labels"]["topic"].alias("topic"), "value")
