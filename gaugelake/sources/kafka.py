"""Message sources with the Kafka schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake.constants import TOPIC_PATTERN

MESSAGE_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("timestampType", T.IntegerType()),
])


def kafka_options(
    servers: str,
    topic_pattern: str = TOPIC_PATTERN,
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
    **extra: str,
) -> dict[str, str]:
    """Options of the ``kafka`` source; ``extra`` passes e.g. ``**{"kafka.security.protocol": …}``."""
    if starting_offsets not in ("latest", "earliest") and not starting_offsets.lstrip().startswith("{"):
        raise ValueError("starting_offsets is latest, earliest or a JSON map of offsets")
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribePattern": topic_pattern,
        "startingOffsets": starting_offsets,
        # expired offsets are reported by lag monitoring and must not stop ingestion
        "failOnDataLoss": "false",
        **extra,
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def kafka_stream(spark: SparkSession, servers: str, **options) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(servers, **options)).load()


def kafka_batch(spark: SparkSession, servers: str, starting_offsets: str = "earliest", **options) -> DataFrame:
    opts = kafka_options(servers, starting_offsets=starting_offsets, **options)
    return spark.read.format("kafka").options(**opts).load()


def replay_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Stored messages as a stream, for backfills and tests."""
    reader = spark.readStream.schema(schema or MESSAGE_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def subscribed(messages: DataFrame, topic_pattern: str = TOPIC_PATTERN) -> DataFrame:
    """Topic-pattern subscription over messages that are already a DataFrame."""
    return messages.where(F.col("topic").rlike(topic_pattern))


def drop_redelivered(messages: DataFrame, watermark: str | None = None, time_col: str = "timestamp") -> DataFrame:
    """One row per (topic, partition, offset).

    In a stream give ``watermark``: state is then kept only that long.
    """
    keys = ["topic", "partition", "offset"]
    if messages.isStreaming:
        if watermark is None:
            raise ValueError("a stream needs a watermark to bound the deduplication state")
        return messages.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(keys)
    return messages.dropDuplicates(keys)
