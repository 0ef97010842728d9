"""Sensor-shaped views over the star-schema tables, so that every query reads the given data.

``messages``   events as topic messages; payload faults follow the ``k`` in ``props``
``samples``    lineitem as measurements of several quantities
``manifest_*`` orders as files on the local and the cold tier
``upload_log`` lineitem as upload and delete entries of those files
``metrics``    events as metric samples
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.constants import TOPIC_PREFIX
from gaugelake.functions.barrier import computed_once
from gaugelake.operators.monitor import as_metrics

# Which k stands for which payload fault. The SQL checks use the same numbers.
NO_TIMESTAMP_TYPE = 3
NULL_VALUE = 7
NOT_JSON = 13
BAD_UTF8 = 21
NAN_VALUE = 29
NO_TIME = 34
NUMERIC_ASSET = 47
NO_ASSET = 55
UNREADABLE_TIME = 62
NUMERIC_TIME = 71
OFFSET_TIME = 80
TEXT_VALUE = 89
SCALAR_PAYLOAD = 96

EVENT_KEY = "k INT"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table of fewer splits than cores dealt out over the cores; a larger one is read as it is split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores, key)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``ts`` as an instant."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _envelope() -> list[Column]:
    return [
        F.concat(F.lit(TOPIC_PREFIX), F.col("event_type")).alias("topic"),
        F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
    ]


def _ingest_ts() -> Column:
    return (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("ingest_ts")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a message says without its payload; questions that need no more should read no more."""
    return events(spark, sf_dir).select(*_envelope(), _ingest_ts())


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = computed_once(spread(events(spark, sf_dir), "event_id"), k=F.from_json("props", EVENT_KEY)["k"])
    k = F.col("k")
    text_time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    time = (
        F.when(k == NO_TIME, F.lit(None))
        .when(k == UNREADABLE_TIME, F.lit('"not a time"'))
        .when(k == NUMERIC_TIME, F.unix_millis("ts").cast("string"))
        .when(k == OFFSET_TIME, quoted(F.concat(text_time, F.lit("+02:00"))))
        .otherwise(quoted(text_time))
    )
    value = (
        F.when(k == NAN_VALUE, F.lit("NaN"))
        .when(k == TEXT_VALUE, quoted(F.col("value").cast("string")))
        .otherwise(F.col("value").cast("string"))
    )
    asset = (
        F.when(k == NO_ASSET, F.lit(None))
        .when(k == NUMERIC_ASSET, F.col("user_id").cast("string"))
        .otherwise(quoted(F.concat(F.lit("asset_"), F.lpad(F.col("user_id").cast("string"), 6, "0"))))
    )
    payload = F.concat(
        F.lit("{"),
        F.concat_ws(",", member("time", time), member("value", value), member("daqid", asset),
                    member("props", F.col("props"))),
        F.lit("}"),
    )
    body = (
        F.when(k == NULL_VALUE, F.lit(None))
        .when(k == NOT_JSON, F.concat(F.lit("corrupt "), F.col("event_id").cast("string")).cast("binary"))
        .when(k == BAD_UTF8, F.concat(F.lit("bad ").cast("binary"), F.unhex(F.lit("FFFE"))))
        .when(k == SCALAR_PAYLOAD, F.col("value").cast("string").cast("binary"))
        .otherwise(payload.cast("binary"))
    )
    return computed_once(source, body=body).select(
        F.col("user_id").cast("string").cast("binary").alias("key"),
        F.col("body").alias("value"),
        *_envelope(),
        F.when(k == NO_TIMESTAMP_TYPE, -1).otherwise(0).alias("timestampType"),
        _ingest_ts(),
    )


SAMPLE_MEASURES = ("quantity", "price", "discount", "tax")


def whole(x: Column) -> Column:
    """What ``round`` makes of a DOUBLE, halves away from zero; that one goes through decimal text for every value."""
    return F.when(F.abs(x - F.rint(x)) == 0.5, x + F.signum(x) * 0.5).otherwise(F.rint(x) + 0.0)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements in few buckets: quarters, two hours of a day, three minutes of an hour. Rows arrive by order, not by time."""
    quarter = F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp"))
    # in seconds as a whole number: an interval would go through decimals for every row
    later = F.col("l_partkey") % 2 * 3600 + F.col("l_linenumber") % 3 * 600 + F.col("l_suppkey") % 60
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.pmod("l_suppkey", F.lit(2)).cast("string").alias("asset_id"),
        F.col("l_returnflag").alias("sensor_name"),
        F.timestamp_micros(F.unix_micros(quarter) + later * 1_000_000).alias("event_time"),
        F.col("l_quantity").alias("quantity"),
        # whole numbers: their means do not end halfway between two rounded values
        whole(F.col("l_extendedprice")).alias("price"),
        whole(F.col("l_discount") * 100).alias("discount"),
        whole(F.col("l_tax") * 100).alias("tax"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + F.col("l_suppkey") % 60).cast("bigint").alias("arrival_order"),
    )


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``samples`` as rows of the raw table, without its partition columns."""
    rows = samples(spark, sf_dir)
    measures = F.create_map(*[x for name in SAMPLE_MEASURES for x in (F.lit(name), F.col(name).cast("double"))])
    none = {"attrs": F.lit(None).cast("map<string,string>"), "partition": F.lit(None).cast("int"), "kafka_timestamp": F.lit(None).cast("bigint")}
    return rows.select(
        "sensor_name", F.col("sensor_name").alias("table_name"), "asset_id", "event_time", F.lit("payload").alias("time_quality"),
        F.concat(F.lit(TOPIC_PREFIX), F.col("sensor_name")).alias("topic"), F.col("arrival_order").alias("offset"),
        F.col("event_time").alias("ingest_ts"), "arrival_order", measures.alias("measures"), *[c.alias(n) for n, c in none.items()])


def _file_path() -> Column:
    return F.concat(
        F.lit("asset_"), F.col("o_custkey").cast("string"), F.lit("/"),
        F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/f_"), F.col("o_orderkey").cast("string"),
        F.lit(".parquet"),
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def manifest_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(
        _file_path().alias("rel_path"),
        F.round("o_totalprice").cast("bigint").alias("size"),
        F.col("o_orderdate").alias("mtime"),
    )


def manifest_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all files but urgent open ones; the priority decides how a copy differs."""
    priority = F.col("o_orderpriority")
    size = F.round("o_totalprice").cast("bigint")
    mirrored = (priority != "1-URGENT") | (F.col("o_orderstatus") != "O")
    return _orders(spark, sf_dir).where(mirrored).select(
        _file_path().alias("rel_path"),
        F.when(priority == "2-HIGH", size + 2000).when(priority == "3-MEDIUM", size + 512)
        .otherwise(size).alias("size"),
        F.when(priority == "5-LOW", F.col("o_orderdate") - F.expr("INTERVAL 1 DAY"))
        .otherwise(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("mtime"),
    )


def upload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per line item: shipped lines are uploads, returned open ones deletions, others failed uploads."""
    items = table(spark, sf_dir, "lineitem")
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _file_path().alias("rel_path"))
    return items.join(files, "l_orderkey").select(
        "rel_path",
        F.when(F.col("l_linestatus") == "F", "uploaded").when(F.col("l_returnflag") == "R", "deleted").otherwise("failed").alias("event"),
        F.col("l_shipdate").cast("timestamp").alias("logged_at"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one gauge, a series per event type and half of the users."""
    return _metric_rows(spark, sf_dir, "event_value", F.col("value"))


def _metric_rows(spark: SparkSession, sf_dir: str, name: str, value: Column) -> DataFrame:
    report = events(spark, sf_dir).select(
        "ts", F.col("event_type").alias("topic"), F.pmod("user_id", F.lit(2)).cast("string").alias("half"), value.alias(name))
    return as_metrics(report, F.col("ts"), ("topic", "half"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter per event type that grows with the event id and starts over every 500 events."""
    return _metric_rows(spark, sf_dir, "events_total", F.pmod("event_id", F.lit(500)).cast("double"))
