from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugelake.session import RUNTIME_CONF, shared_dir
from gaugelake.sources import incremental as I
from gaugelake.sources import kafka as K


def test_kafka_options():
    o = K.kafka_options("b:9092", max_offsets_per_trigger=500, **{"kafka.group.id": "g"})
    assert o["subscribePattern"] == "^sensor-data-quad.*" and o["startingOffsets"] == "latest"
    assert o["maxOffsetsPerTrigger"] == "500" and o["kafka.group.id"] == "g"
    assert "maxOffsetsPerTrigger" not in K.kafka_options("b:9092")
    assert K.kafka_options("b:9092", starting_offsets="earliest")["startingOffsets"] == "earliest"
    with pytest.raises(ValueError):
        K.kafka_options("b:9092", starting_offsets="newest")


def test_topic_subscription(make_messages):
    m = make_messages(("sensor-data-quad_ch1", 1, "{}"), ("sensor-data-other", 2, "{}"), ("x-sensor-data-quad", 3, "{}"))
    assert [r.offset for r in K.subscribed(m).collect()] == [1]


def test_replay_respects_the_batch_bound(spark, make_messages, tmp_path):
    source = str(tmp_path / "in")
    make_messages(*[("t", i, "{}") for i in range(8)]).repartition(4).write.parquet(source)
    sizes = []
    q = K.replay_stream(spark, source, 1).writeStream.foreachBatch(lambda df, i: sizes.append(df.count())).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(sizes) == 4 and sum(sizes) == 8


def test_jdbc_options():
    hw, until = datetime(2024, 1, 1), datetime(2024, 1, 2)
    o = I.jdbc_options("jdbc:x", "sensor_data", high_water=hw, until=until, partitions=8, fetchsize="1000")
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == (
        "timestamp", "2024-01-01 00:00:00", "2024-01-02 00:00:00", "8")
    assert o["fetchsize"] == "1000"
    o = I.jdbc_options("jdbc:x", "sensor_data", high_water=hw, until=until)
    assert o["numPartitions"] == "16" and o["fetchsize"] == "10000"
    assert "partitionColumn" not in I.jdbc_options("jdbc:x", "sensor_data")
    o = I.jdbc_options("jdbc:x", "sensor_data", high_water=hw, max_rows=1000)
    assert o["dbtable"] == ("(SELECT * FROM sensor_data WHERE timestamp > TIMESTAMP '2024-01-01 00:00:00' "
                            "ORDER BY timestamp FETCH FIRST 1000 ROWS WITH TIES) AS capped")
    assert "partitionColumn" not in o


@pytest.fixture(scope="module")
def sensor_data(spark):
    rows = [("s1", datetime(2024, 1, 1, 0, m), m) for m in (5, 1, 3, 3, 3, 9)]
    return spark.createDataFrame(rows, "sensor_id string, timestamp timestamp, v int")


def test_incremental_pulls_miss_nothing(sensor_data):
    """Pull with a cap until nothing is left; every row comes exactly once."""
    high, seen, pulls = None, [], 0
    while True:
        batch = I.capped(I.pulled(sensor_data, high_water=high), max_rows=2)
        got = batch.collect()
        if not got:
            break
        seen += [r.v for r in got]
        high = I.next_high_water(batch, high_water=high).first().high_water
        pulls += 1
    assert sorted(seen) == [1, 3, 3, 3, 5, 9] and pulls == 2
    assert I.next_high_water(I.pulled(sensor_data, high_water=high), high_water=high).first() == (high, 0)
    assert I.pulled(sensor_data, high_water=datetime(2024, 1, 1, 0, 3), until=datetime(2024, 1, 1, 0, 5)).count() == 1


def test_pull_predicate_reaches_the_scan(spark, sensor_data, tmp_path):
    path = str(tmp_path / "t")
    sensor_data.write.parquet(path)
    plan = I.pulled(spark.read.parquet(path), high_water=datetime(2024, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(timestamp,2024-01-01" in plan


def test_keyed_messages(spark, sensor_data):
    m = I.as_messages(sensor_data.limit(1).withColumn("n", F.lit(None).cast("int")), "sensor_id", F.lit("quad"))
    r = m.first()
    assert (r.topic, r.key) == ("sensor-data-quad", "s1") and '"sensor_id":"s1"' in r.value
    assert I.unkeyed(m.withColumn("key", F.lit(None).cast("string"))).count() == 1


def test_session(spark):
    assert all(spark.conf.get(k) == v for k, v in RUNTIME_CONF.items())
    assert shared_dir(spark) == shared_dir(spark)
