import json
import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from times import utc
from gaugelake.functions import naming as N
from gaugelake.functions import timing as T
from gaugelake.functions import variants as V
from gaugelake.operators import parse as P

INGEST = datetime(2024, 5, 5, 12, 0, 0)


def rows_of(make_messages, payloads, **options):
    messages = make_messages(*[("sensor-data-a", i, p) for i, p in enumerate(payloads)])
    routed = P.routed_messages(messages, F.lit(INGEST).cast("timestamp"), **options)
    return {r.offset: r for r in routed.drop("data", "text").collect()}


def test_envelope_of_a_good_message(make_messages):
    m = make_messages(("sensor-data-quad_ch1", 100, '{"temperature": 25.5}', utc(2024, 1, 1), 1))
    r = P.parse_messages(m).select("*", F.to_json("data").alias("json")).drop("data").first()
    assert (r.sensor_name, r.table_name, r.topic, r.partition, r.offset) == (
        "quad_ch1", "quad_ch1", "sensor-data-quad_ch1", 0, 100)
    assert r.kafka_timestamp == 1704067200000
    assert json.loads(r.json) == {"temperature": 25.5}
    assert r.parse_status == "json"


def test_unset_timestamp_type_gives_no_kafka_timestamp(make_messages):
    m = make_messages(("sensor-data-a", 1, "{}", utc(2024, 1, 1), -1))
    assert P.parse_messages(m).first().kafka_timestamp is None


def test_statuses_and_rejects(make_messages):
    m = make_messages(("t", 1, None), ("t", 2, "invalid json"), ("t", 3, b"\xff\xfe"), ("t", 4, "{}"))
    parsed = P.parse_messages(m)
    assert {r.offset: r.parse_status for r in parsed.drop("data").collect()} == {
        1: "null_value", 2: "raw_text", 3: "invalid_utf8", 4: "json"}
    assert {r.offset: r.reason for r in P.rejects(P.decode(m)).collect()} == {1: "null_value", 3: "invalid_utf8"}
    kept = P.accepted(parsed).select("offset", F.to_json("data").alias("j")).collect()
    assert {r.offset: json.loads(r.j) for r in kept} == {2: {"value": "invalid json"}, 4: {}}


@pytest.mark.parametrize("text, status", [
    ('{"a":1}', "json"), ("12", "json"), ('"s"', "json"), ("null", "json"), ("[1,2]", "json"), (' {"a":1}\n', "json"),
    ('{"a":NaN}', "json"), ('{"a":1} tail', "raw_text"), ("12 abc", "raw_text"), ("", "raw_text"), ("1,2", "raw_text"),
    ("1],[2", "raw_text"), ("{'a':1}", "raw_text"), ("{'a':NaN}", "raw_text"), ('{"a":', "raw_text"),
])
def test_only_whole_documents_are_json(make_messages, text, status):
    assert P.parse_messages(make_messages(("t", 1, text))).first().parse_status == status


def test_repeated_key_keeps_the_last(make_messages):
    r = P.parse_messages(make_messages(("t", 1, '{"a":1,"a":2}'))).select(F.to_json("data").alias("j")).first()
    assert json.loads(r.j) == {"a": 2}


@pytest.mark.parametrize("topic, sensor, table", [
    ("sensor-data-quad_ch1", "quad_ch1", "quad_ch1"),
    ("plant.sensor-data-x", "x", "unknown_table"),
    ("other", "other", "unknown_table"),
    ("sensor-data-a-sensor-data-b", "a-sensor-data-b", "a-b"),
    ("sensor-data-", "sensor-data-", ""),
])
def test_names_from_topics(spark, topic, sensor, table):
    t = F.lit(topic)
    r = spark.range(1).select(N.sensor_name(t).alias("s"), N.table_name(t).alias("t")).first()
    assert (r.s, r.t) == (sensor, table)


@pytest.mark.parametrize("payload, time, quality", [
    ('{"time":"2024-01-15T10:20:30.5"}', datetime(2024, 1, 15, 10, 20, 30, 500000), "payload"),
    ('{"time":"2024-01-15T10:20:30Z"}', datetime(2024, 1, 15, 10, 20, 30), "payload"),
    ('{"time":"2024-01-15T10:20:30+02:00"}', datetime(2024, 1, 15, 8, 20, 30), "payload"),
    ('{"time":"2024-01-15 10:20:30"}', datetime(2024, 1, 15, 10, 20, 30), "payload"),
    ('{"time":"2024/01/15 10:20:30"}', datetime(2024, 1, 15, 10, 20, 30), "payload"),
    ('{"time":"20240115"}', datetime(2024, 1, 15), "payload"),
    ('{"time":"01/15/2024"}', datetime(2024, 1, 15), "payload"),
    ('{"time":"Jan 5, 2024 10:00"}', datetime(2024, 1, 5, 10), "payload"),
    ('{"time":"January 5, 2024"}', datetime(2024, 1, 5), "payload"),
    ('{"time":"2024-01-05 10:00 PM"}', datetime(2024, 1, 5, 22), "payload"),
    ('{"time":"20240105T100000Z"}', datetime(2024, 1, 5, 10), "payload"),
    ('{"time":"5/1/2024 10:00"}', datetime(2024, 5, 1, 10), "payload"),
    ('{"time":"Fri, 05 Jan 2024 10:00:00 GMT"}', datetime(2024, 1, 5, 10), "payload"),
    ('{"time":"2024/01/05 10:00:00.5"}', datetime(2024, 1, 5, 10, 0, 0, 500000), "payload"),
    ('{"time":1704067200000}', datetime(2024, 1, 1), "payload"),
    ('{"time":"soon"}', INGEST, "fallback"),
    ('{"time":[1]}', INGEST, "fallback"),
    ('{"time":true}', INGEST, "fallback"),
    ('{"time":""}', INGEST, "ingest"),
    ('{"time":0}', INGEST, "ingest"),
    ('{"time":null}', INGEST, "ingest"),
    ('{"timestamp":"2024-01-15"}', INGEST, "ingest"),
    ("42", INGEST, "ingest"),
    ("null", INGEST, "ingest"),
])
def test_event_time(make_messages, payload, time, quality):
    r = rows_of(make_messages, [payload])[0]
    assert (r.event_time, r.time_quality) == (time, quality)


def test_event_time_options(make_messages):
    payloads = ['{"time":"2024-01-15T10:20:30+02:00"}', '{"time":1704067200000}']
    rows = rows_of(make_messages, payloads, bucket_clock="source", numeric_time_unit="ns")
    assert rows[0].event_time == datetime(2024, 1, 15, 10, 20, 30)
    assert rows[1].event_time.replace(microsecond=0) == datetime(1970, 1, 1, 0, 28, 24)
    late = ['{"timestamp":"2024-01-15T01:00:00","asset_id":"a7"}', '{"time":"2024-01-16","daqid":"d"}']
    rows = rows_of(make_messages, late, time_fields=("time", "timestamp"), asset_fields=("daqid", "asset_id"))
    assert [(r.event_time, r.asset_id) for r in rows.values()] == [
        (datetime(2024, 1, 15, 1), "a7"), (datetime(2024, 1, 16), "d")]


@pytest.mark.parametrize("payload, asset", [
    ('{"daqid":"a1"}', "a1"), ('{"daqid":7}', "7"), ('{"daqid":0}', "unknown_asset"), ('{"daqid":"0"}', "0"),
    ('{"daqid":""}', "unknown_asset"), ('{"daqid":null}', "unknown_asset"), ('{"daqid":true}', "True"),
    ('{"daqid":false}', "unknown_asset"), ('{"daqid":[]}', "unknown_asset"), ('{"daqid":{}}', "unknown_asset"),
    ('{"daqid":1.0}', "1.0"), ('{"daqid":-2.50}', "-2.5"), ('{"daqid":12}', "12"), ("{}", "unknown_asset"), ("[1]", "unknown_asset"),
])
def test_asset(make_messages, payload, asset):
    assert rows_of(make_messages, [payload])[0].asset_id == asset


def test_arrival_order_sorts_like_partition_and_offset(spark):
    df = spark.createDataFrame([(0, 5), (0, 2**40), (1, 0), (2, 1), (300, 7)], "p int, o bigint")
    ordered = df.select("p", "o", N.arrival_order(F.col("p"), F.col("o")).alias("a")).orderBy("a").collect()
    assert [(r.p, r.o) for r in ordered] == [(0, 5), (0, 2**40), (1, 0), (2, 1), (300, 7)]


def test_numbers_only_are_measures(spark):
    data = F.parse_json(F.lit('{"i":1,"d":1.5,"b":true,"s":"2","n":null,"l":[1],"big":1e300}'))
    df = spark.range(1).select(data.alias("d"))
    got = df.select(*[
        V.as_measure(V.field(F.col("d"), k), V.kind(V.field(F.col("d"), k))).alias(k)
        for k in ("i", "d", "b", "s", "n", "l", "big", "none")
    ]).first().asDict()
    assert got == {"i": 1.0, "d": 1.5, "b": None, "s": None, "n": None, "l": None, "big": 1e300, "none": None}


def test_keys_with_odd_characters(spark):
    data = F.parse_json(F.lit('{"a b":{"c.d":1}}'))
    assert spark.range(1).select(V.as_text(V.field(data, "a b", "c.d")).alias("v")).first().v == "1"


def test_time_literals_do_not_depend_on_the_process(spark):
    aware = datetime(2024, 1, 1, 2, tzinfo=timezone(timedelta(hours=2)))
    old = os.environ["TZ"]
    os.environ["TZ"] = "America/New_York"
    time.tzset()
    try:
        r = spark.range(1).select(*[
            F.unix_seconds(T.instant(x)).alias(n) for n, x in (("naive", datetime(2024, 1, 1)), ("aware", aware), ("day", aware.date()))
        ]).first()
    finally:
        os.environ["TZ"] = old
        time.tzset()
    assert (r.naive, r.aware, r.day) == (1704067200,) * 3
