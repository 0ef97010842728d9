"""Messages -> envelopes -> routed rows, with rejects kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.constants import UNKNOWN_ASSET, UNKNOWN_SENSOR
from gaugelake.functions import naming as N
from gaugelake.functions import timing as T
from gaugelake.functions import variants as V
from gaugelake.functions.barrier import computed_once


def decode(messages: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Messages with the Kafka source schema -> envelope columns and the decoded ``text``.

    Without ``ingest_ts`` processing time is the query's ``current_timestamp()``; in a stream that
    value comes from the offset log, so a replayed micro-batch sees the same one.
    """
    if ingest_ts is None:
        ingest_ts = F.col("ingest_ts") if "ingest_ts" in messages.columns else F.current_timestamp()
    return messages.select(
        N.sensor_name(F.col("topic")).alias("sensor_name"),
        N.table_name(F.col("topic")).alias("table_name"),
        "topic", "partition", "offset",
        F.when(F.col("timestampType") != -1, F.unix_millis(F.col("timestamp"))).alias("kafka_timestamp"),
        ingest_ts.alias("ingest_ts"),
        "value",
        F.try_validate_utf8(F.col("value").cast("string")).alias("text"),
    )


def parse_messages(messages: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """One row per message with the payload as VARIANT ``data`` and a parse status.

    Status: ``json``, ``raw_text`` (kept as ``{"value": text}``), ``null_value``, ``invalid_utf8``.
    """
    decoded = decode(messages, ingest_ts)
    parsed = computed_once(decoded, _doc=V.parse_json_strict(F.col("text")))
    is_json = V.is_document(F.col("_doc"))
    as_value = F.to_variant_object(F.struct(F.col("text").alias("value")))
    return parsed.select(
        *decoded.columns,
        F.when(is_json, V.document(F.col("_doc"))).when(F.col("text").isNotNull(), as_value).alias("data"),
        F.when(F.col("value").isNull(), "null_value")
        .when(F.col("text").isNull(), "invalid_utf8")
        .when(is_json, "json")
        .otherwise("raw_text").alias("parse_status"),
    )


# Both sides test the decoded text, not the status: the status depends on the JSON parse, and a
# filter on it would be pushed below the projection and parse every document a second time.

def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("text").isNotNull()).drop("value")


def rejects(decoded: DataFrame) -> DataFrame:
    """Messages that carry no usable value, with the reason; decoding is enough to tell."""
    return decoded.where(F.col("text").isNull()).select(
        "topic", "partition", "offset", "value", "ingest_ts",
        F.when(F.col("value").isNull(), "null_value").otherwise("invalid_utf8").alias("reason"),
    )


def route(
    envelopes: DataFrame,
    *,
    time_fields: Sequence[str] = ("time",),
    asset_fields: Sequence[str] = ("daqid",),
    bucket_clock: str = "utc",
    numeric_time_unit: str = "ms",
) -> DataFrame:
    """Add ``event_time``, ``time_quality``, ``asset_id`` and ``arrival_order``.

    The first listed field that is given decides. Time quality: ``payload`` (from the payload),
    ``fallback`` (given but unreadable), ``ingest`` (not given).
    """
    fields = {name: f"_field{i}" for i, name in enumerate(dict.fromkeys((*time_fields, *asset_fields)))}
    data = F.col("data")
    found = envelopes.select("*", *[V.field(data, name).alias(c) for name, c in fields.items()])
    kinds = found.select("*", *[V.kind(F.col(c)).alias(f"{c}_kind") for c in fields.values()])

    def first_given(names: Sequence[str]) -> Column:
        """The first non-empty field, with its kind."""
        candidates = [(F.col(fields[n]), F.col(f"{fields[n]}_kind")) for n in names]
        return F.coalesce(*[
            F.when(V.is_truthy(value, kind), F.struct(value.alias("value"), kind.alias("kind")))
            for value, kind in candidates
        ])

    given = kinds.select("*", first_given(time_fields).alias("_time"), first_given(asset_fields).alias("_asset"))
    time, asset = F.col("_time"), F.col("_asset")
    timed = given.withColumn(
        "_event_time", T.payload_time(time["value"], time["kind"], bucket_clock, numeric_time_unit)
    )
    asset_text = F.when(asset["kind"] == "BOOLEAN", F.lit("True")).otherwise(V.as_written(asset["value"], asset["kind"]))
    routed = computed_once(
        timed,
        event_time=F.coalesce("_event_time", "ingest_ts"),
        time_quality=F.when(time.isNull(), "ingest").when(F.col("_event_time").isNull(), "fallback").otherwise("payload"),
        asset_id=F.coalesce(asset_text, F.lit(UNKNOWN_ASSET)),
    )
    return routed.select(
        *envelopes.columns, "event_time", "time_quality", "asset_id",
        N.arrival_order(F.col("partition"), F.col("offset")).alias("arrival_order"),
    )


def routed_messages(messages: DataFrame, ingest_ts: Column | None = None, **options) -> DataFrame:
    """Messages straight to accepted, routed rows."""
    rows = route(accepted(parse_messages(messages, ingest_ts)), **options)
    return rows.withColumn(
        "sensor_name", F.coalesce("sensor_name", "table_name", F.lit(UNKNOWN_SENSOR))
    )
