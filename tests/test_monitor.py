import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugelake.operators import monitor as M

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def metrics(spark):
    def make(*rows):
        return spark.createDataFrame([(at(s), n, v) for s, n, v in rows], "ts timestamp, name string, value double").withColumn(
            "series", F.lit(""))
    return make


def test_counter_rate_handles_resets(metrics):
    df = metrics((0, "c", 10.0), (60, "c", 40.0), (120, "c", 5.0), (180, "c", 20.0), (300, "c", 21.0), (0, "d", 1.0), (30, "d", None))
    got = {(r.name, r.window_start): (r.samples, r.increase, r.rate) for r in M.counter_rate(df).collect()}
    assert got == {("c", at(0)): (4, 50.0, 50 / 300), ("c", at(300)): (1, 0.0, 0.0), ("d", at(0)): (1, 0.0, 0.0)}


@pytest.mark.parametrize("grain", ["1 second", "10 seconds", "60 seconds"])
def test_counter_rate_in_two_levels_equals_brute_force(metrics, grain):
    rng = random.Random(7)
    rows, value = [], 0.0
    for i in range(3000):
        value = 0.0 if rng.random() < 0.01 else value + rng.randint(0, 9)
        rows.append((i * 0.7, "hot", value))
    want = {}
    for i, (s, _, v) in enumerate(rows):
        w = int(s // 300)
        want.setdefault(w, 0.0)
        if i and int(rows[i - 1][0] // 300) == w:
            p = rows[i - 1][2]
            want[w] += v - p if v >= p else v
    got = {int((r.window_start - T0).total_seconds() // 300): r.increase for r in M.counter_rate(metrics(*rows), grain=grain).collect()}
    assert got == want


def test_message_and_failure_rates(spark):
    rows = spark.createDataFrame([("t", at(s), s % 3 == 0) for s in range(600)], "topic string, ts timestamp, bad boolean")
    assert [(r.messages, r.rate) for r in M.message_rate(rows, ["topic"], "ts").collect()] == [(300, 1.0)] * 2
    r = M.failure_rate(rows, F.col("bad"), ["topic"], "ts", limit=0.3).orderBy("window_start").first()
    assert (r.total, r.failures, r.failure_rate, r.breach) == (300, 100, 100 / 300, True)


def test_lag(spark):
    latest = spark.createDataFrame([("t", 0, 100), ("t", 0, 50), ("t", 1, 9)], "topic string, partition int, offset bigint")
    done = latest.where("offset = 50")
    got = {r.partition: (r.committed_offset, r.lag, r.breach) for r in M.consumer_lag(latest, done, 49).collect()}
    assert got == {0: (50, 50, True), 1: (-1, 10, False)}


def test_silences(spark):
    seconds = [0, 10, 299, 1500, 1600, 4000]
    rows = spark.createDataFrame([("t", at(s)) for s in seconds], "topic string, ts timestamp")
    got = [(r.gap_start, r.gap_end, r.gap_seconds) for r in M.silences(rows, ["topic"], "ts", at(4300)).orderBy("gap_start").collect()]
    assert got == [(at(300), at(1500), 1200.0), (at(1800), at(3900), 2100.0)]
    tail = M.silences(rows, ["topic"], "ts", at(5100)).orderBy("gap_start").collect()[-1]
    assert (tail.gap_start, tail.gap_end) == (at(4200), at(5100))
    # rows after ``until`` do not count, series that never came are silent throughout
    early = M.silences(rows, ["topic"], "ts", at(1400)).collect()
    assert [(r.gap_start, r.gap_end) for r in early] == [(at(300), at(1400))]
    expected = spark.createDataFrame([("t",), ("u",)], "topic string")
    got = M.silences(rows, ["topic"], "ts", at(4300), expected=expected, since=at(0)).where("topic = 'u'").collect()
    assert [(r.gap_start, r.gap_end) for r in got] == [(at(0), at(4300))]


def test_usage(spark):
    used = spark.createDataFrame([("a", 50), ("a", 40), ("b", 1), ("c", 1)], "asset_id string, size bigint")
    capacity = spark.createDataFrame([("a", 100), ("b", 100), ("c", 0)], "asset_id string, capacity_bytes bigint")
    assert {r.asset_id: (r.usage, r.breach) for r in M.usage_ratio(used, capacity, ["asset_id"]).collect()} == {
        "a": (0.9, True), "b": (0.01, False)}


def test_held_thresholds(metrics):
    values = [1, 9, 9, 9, 1, 9, 9, 9, 9, 9, 9, 9, 2]
    df = metrics(*[(60 * i, "m", float(v)) for i, v in enumerate(values)], (60 * 3 + 30, "m", 8.0), *[
        (s, "gap", 9.0) for s in (0, 60, 1000, 1060)])
    got = [(r.name, r.held_from, r.held_until, r.held_seconds, r.steps, r.peak) for r in M.held_thresholds(df, 5.0, 300).collect()]
    assert got == [("m", at(300), at(660), 360, 7, 9.0)]
    short = {(r.name, r.held_from) for r in M.held_thresholds(df, 5.0, 60).collect()}
    assert short == {("m", at(60)), ("m", at(300)), ("gap", at(0)), ("gap", at(960))}


def test_freshness(spark, metrics):
    hours = spark.createDataFrame([("s", at(0)), ("s", at(3600)), ("u", at(9000))], "sensor_name string, hour_bucket timestamp")
    got = {r.sensor_name: (r.delay_seconds, r.breach) for r in M.rollup_delay(hours, at(10801), ["sensor_name"]).collect()}
    assert got == {"s": (7201.0, True), "u": (1801.0, False)}
    rows = spark.createDataFrame([("a", at(0)), ("b", at(700)), ("b", at(100))], "topic string, ts timestamp")
    assert [(r.topic, r.age_seconds) for r in M.stale_sources(rows, at(1000), ["topic"], "ts").collect()] == [("a", 1000.0)]
    last = M.last_values(metrics((0, "m", 1.0), (60, "m", 2.0), (90, "m", None))).first()
    assert (last.last_ts, last.last_value) == (at(60), 2.0)


def test_health(spark):
    rows = spark.createDataFrame(
        [("a", "s1", at(990), False), ("a", "s2", at(0), False), ("b", "s1", at(990), False), ("c", "s1", at(990), True)],
        "asset string, sensor string, ts timestamp, bad boolean")
    got = {r.asset: (r.sensors, r.stale_sensors, r.failing_sensors, r.healthy, r.issues)
           for r in M.health(rows, at(1000), "asset", "sensor", "ts", F.col("bad")).collect()}
    assert got == {"a": (2, 1, 0, False, "stale"), "b": (1, 0, 0, True, ""), "c": (1, 0, 1, False, "failing")}


def test_reports_become_metrics(spark):
    report = spark.createDataFrame([("t", 3, True, "x")], "topic string, n int, breach boolean, note string")
    got = {(r.ts, r.name, r.labels["topic"], r.value) for r in M.as_metrics(report, T0, ["topic"]).collect()}
    assert got == {(T0, "n", "t", 3.0), (T0, "breach", "t", 1.0)}
    assert M.as_metrics(report.select("n"), T0).first().labels == {}


def test_labelled_series_are_apart(spark, tmp_path):
    """Two topics whose counters grow by 1 each: the increase is 2, not the jumps between them."""
    for second, (a, b) in ((0, (10, 1000)), (60, (11, 1001))):
        report = spark.createDataFrame([("a", a), ("b", b)], "topic string, seen int")
        M.write_metrics(M.as_metrics(report, at(second), ["topic"]), str(tmp_path / "metrics"))
    metrics = spark.read.parquet(str(tmp_path / "metrics"))
    got = {r.series: r.increase for r in M.counter_rate(metrics).collect()}
    assert got == {"topic=a": 1.0, "topic=b": 1.0}
    assert {r.series: r.last_value for r in M.last_values(metrics).collect()} == {"topic=a": 11.0, "topic=b": 1001.0}
