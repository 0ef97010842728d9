from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugelake.operators import rollup as R

START = datetime(2024, 1, 15, 10)


@pytest.fixture(scope="module")
def minutes_input(spark):
    """5 minutes of 6 samples each, every 10 seconds."""
    rows = [
        ("temp_sensor", "asset_001", START + timedelta(minutes=m, seconds=s), 20 + m + s / 60, 50.0 + 2 * m, m * 60 + s)
        for m in range(5) for s in range(0, 60, 10)
    ]
    return spark.createDataFrame(
        rows, "sensor_name string, asset_id string, event_time timestamp, temperature double, humidity double, arrival_order bigint")


def test_minute_values(minutes_input):
    rows = R.minute_rollup(minutes_input, ["temperature", "humidity"]).orderBy("minute_bucket").collect()
    assert len(rows) == 5
    for m, r in enumerate(rows):
        assert r.minute_bucket == r.timestamp_first == START + timedelta(minutes=m)
        assert r.temperature_mean == pytest.approx(20 + m + 25 / 60)
        assert r.temperature_min == 20 + m
        assert r.temperature_max == pytest.approx(20 + m + 50 / 60)
        assert r.humidity_mean == r.humidity_min == r.humidity_max == 50 + 2 * m


def test_columns_are_found_by_type(minutes_input):
    df = minutes_input.withColumns({"flag": F.lit(True), "kafka_timestamp": F.lit(1), "offset": F.lit(2)})
    assert R.numeric_columns(df) == ["temperature", "humidity"]
    assert R.stat_columns(df.withColumn("a_Timestamp_mean", F.lit(1.0))) == ["temperature", "humidity"]


def _pandas_level(df, keys, first):
    stats = [c for c in df.columns if df[c].dtype.kind == "f"]
    out = df.groupby(keys).agg({**{c: ["mean", "min", "max"] for c in stats}, first: "first"}).reset_index()
    out.columns = ["_".join(c).strip("_") if c[1] else c[0] for c in out.columns]
    return out


def test_cascade_equals_pandas(spark):
    rows = [
        (f"s{i % 2}", f"a{i % 3}", START + timedelta(minutes=7 * i), float(i * i % 101), i)
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "sensor_name string, asset_id string, event_time timestamp, v double, arrival_order bigint")
    got = R.cascade(df, ["v"]).toPandas()
    keys = ["sensor_name", "asset_id"]
    pdf = pd.DataFrame(rows, columns=["sensor_name", "asset_id", "timestamp", "v", "o"]).drop(columns="o")
    pdf["minute_bucket"] = pdf["timestamp"].dt.floor("min")
    minute = _pandas_level(pdf, ["minute_bucket", *keys], "timestamp").drop(columns="timestamp_first")
    minute["hour_bucket"] = minute["minute_bucket"].dt.floor("h")
    hour = _pandas_level(minute, ["hour_bucket", *keys], "minute_bucket").drop(columns="minute_bucket_first")
    hour["day_bucket"] = hour["hour_bucket"].dt.date
    day = _pandas_level(hour, ["day_bucket", *keys], "hour_bucket")
    assert set(got.columns) == set(day.columns) and len([c for c in day.columns if c.startswith("v_")]) == 27
    order = ["day_bucket", *keys]
    got = got.sort_values(order, ignore_index=True)[day.columns]
    pd.testing.assert_frame_equal(got, day.sort_values(order, ignore_index=True), check_dtype=False)


def test_levels_one_by_one_equal_the_cascade(minutes_input):
    columns = ["temperature", "humidity"]
    stepwise = R.day_rollup(R.hour_rollup(R.minute_rollup(minutes_input, columns)))
    assert stepwise.collect()[0].asDict() == R.cascade(minutes_input, columns).collect()[0].asDict()


def test_nan_and_null(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("s", "a", START, nan, 1), ("s", "a", START, 2.0, 2), ("s", "a", START, None, 3), ("s", "b", START, None, 4),
         ("s", "c", START, nan, 5), (None, "a", START, 1.0, 6), ("s", None, START, 1.0, 7)],
        "sensor_name string, asset_id string, event_time timestamp, v double, arrival_order bigint")
    got = {r.asset_id: (r.v_mean, r.v_min, r.v_max) for r in R.minute_rollup(df, ["v"]).collect()}
    # all-null rows are no records; an all-NaN group is one without a value; null keys drop out
    assert got == {"a": (2.0, 2.0, 2.0), "c": (None, None, None)}


def test_first_is_by_arrival(spark):
    df = spark.createDataFrame(
        [("s", "a", START + timedelta(seconds=50), 1.0, 1), ("s", "a", START, 2.0, 2)],
        "sensor_name string, asset_id string, event_time timestamp, v double, arrival_order bigint")
    assert R.minute_rollup(df, ["v"]).first().timestamp_first == START + timedelta(seconds=50)


def test_targets_are_full_hours_and_days(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 15, 10, 59),), (datetime(2024, 1, 15, 11),), (datetime(2024, 1, 16, 10, 5),)],
        "minute_bucket timestamp")
    assert [r[0] for r in R.in_hour(df, datetime(2024, 1, 15, 10, 30)).collect()] == [datetime(2024, 1, 15, 10, 59)]
    assert R.in_day(df, date(2024, 1, 15), "minute_bucket").count() == 2


def test_text_buckets_and_back(minutes_input):
    minutes = R.minute_rollup(minutes_input, ["temperature"])
    hours = R.hour_rollup(minutes)
    assert R.text_buckets(minutes).agg(F.min("minute_bucket")).first()[0] == "2024-01-15T10:00:00"
    r = R.text_buckets(hours).first()
    assert (r.hour_bucket, r.minute_bucket_first) == ("2024-01-15 10:00:00", "2024-01-15T10:00:00")
    d = R.text_buckets(R.day_rollup(hours)).first()
    assert (d.day_bucket, d.hour_bucket_first) == ("2024-01-15", "2024-01-15 10:00:00")
    assert R.text_buckets(hours).select(R.parse_bucket(F.col("hour_bucket")).alias("t")).first().t == START


def test_pivot_of_long_rollups(minutes_input):
    long = minutes_input.select(
        "sensor_name", "asset_id", "event_time", "arrival_order",
        F.explode(F.create_map(F.lit("temperature"), "temperature", F.lit("humidity"), "humidity")).alias("measure", "value"))
    wide = R.pivot_measures(R.minute_rollup(long, ["value"], R.LONG_KEYS), ["temperature", "humidity"])
    direct = R.minute_rollup(minutes_input, ["temperature", "humidity"])
    assert sorted(map(str, wide.select(*direct.columns).collect())) == sorted(map(str, direct.collect()))


def test_minutes_are_whole_numbers_and_equal_date_trunc(spark):
    micros = [None, 0, -1, 59_999_999, 60_000_000, -60_000_000, -62_135_596_800_000_001, 253_402_300_800_000_000]
    times = spark.createDataFrame([(m,) for m in micros], "m bigint").select(F.timestamp_micros("m").alias("t"))
    both = times.select(R.minute_of("t").alias("ours"), F.date_trunc("minute", "t").alias("theirs"))
    assert both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).count() == 0
    rows = times.selectExpr("t AS event_time", "'s' AS sensor_name", "'a' AS asset_id", "1D AS v", "1L AS arrival_order")
    assert "date_trunc" not in R.minute_rollup(rows, ["v"])._jdf.queryExecution().analyzed().toString()
