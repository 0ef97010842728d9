import glob
import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from times import utc
from gaugelake.operators import flatten as FL
from gaugelake.operators import monitor as M
from gaugelake.operators import rollup as R
from gaugelake.plans import refresh
from gaugelake.plans import views as W
from gaugelake.sources import kafka as K
from gaugelake.streaming import ingest, windows
from gaugelake.streaming.progress import record_progress


@pytest.fixture(scope="module")
def replay(spark, sf_dir, tmp_path_factory):
    """The message view as stored files in scrambled order, and as one DataFrame."""
    path = str(tmp_path_factory.mktemp("replay"))
    days = W.messages(spark, sf_dir).where("timestamp < '2024-01-06'")
    days.repartition(6, "offset").write.mode("overwrite").parquet(path)
    return path, spark.read.parquet(path)


def stream_of(spark, replay, files=2):
    return K.replay_stream(spark, replay[0], files, replay[1].schema)


def rows(df, digits=6):
    from gaugelake.plans.queries import rounded

    return sorted(map(str, rounded(df, digits).collect()))


def run(query):
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def test_ingest_lands_every_message_once(spark, replay, tmp_path):
    root, checkpoint = str(tmp_path / "lake"), str(tmp_path / "cp")
    query = run(ingest.start_ingest(stream_of(spark, replay), root, checkpoint=checkpoint, drain=True))
    batch = ingest.raw_rows(replay[1])
    raw = refresh.table(spark, root, "raw")
    columns = [c for c in batch.columns if c not in ("measures", "attrs")]
    assert rows(raw.select(columns)) == rows(batch.select(columns))
    assert rows(FL.explode_measures(raw).select("offset", "measure", "value")) == rows(
        FL.explode_measures(batch).select("offset", "measure", "value"))
    assert raw.select("ingest_batch").distinct().count() > 1
    refused = spark.read.parquet(f"{root}/rejects")
    assert refused.count() + raw.count() == replay[1].count()
    counted = [p.observedMetrics["ingest"] for p in query.recentProgress if "ingest" in p.observedMetrics]
    assert sum(m.messages_consumed for m in counted) == raw.count()
    assert sum(m.messages_failed for m in counted) == refused.count()
    before, refused_before = raw.count(), refused.count()

    # the last commit is lost, as when the driver dies between the write and the commit
    commits = sorted((f for f in glob.glob(f"{checkpoint}/commits/*")), key=lambda f: int(os.path.basename(f)))
    os.replace(commits[-1], str(tmp_path / "lost"))
    crc = os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc")
    if os.path.exists(crc):
        os.replace(crc, str(tmp_path / "lost.crc"))
    run(ingest.start_ingest(stream_of(spark, replay), root, checkpoint=checkpoint, drain=True))
    assert refresh.table(spark, root, "raw").count() == before
    assert spark.read.parquet(f"{root}/rejects").count() == refused_before


def test_hook_and_own_clock(spark, make_messages, tmp_path):
    source = str(tmp_path / "in")
    make_messages(("sensor-data-a", 1, '{"v":1}'), ("sensor-data-a", 2, '{"v":2}'), ("sensor-data-a", 3, "x")).write.parquet(source)
    seen = K.replay_stream(spark, source)
    root = str(tmp_path / "lake")
    run(ingest.start_ingest(
        seen, root, checkpoint=str(tmp_path / "cp"), drain=True, name="hooked", max_rows_per_file=1,
        hook=lambda df: df.where("offset <> 2").withColumn("asset_id", F.lit("hooked"))))
    raw = refresh.table(spark, root, "raw").collect()
    assert sorted((r.offset, r.asset_id, r.measures) for r in raw) == [(1, "hooked", {"v": 1.0}), (3, "hooked", {})]
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    assert all(abs(now - r.ingest_ts) < timedelta(minutes=10) and r.time_quality == "ingest" for r in raw)


@pytest.fixture(scope="module")
def minute_rows(replay):
    return R.minute_rollup(FL.explode_measures(ingest.raw_rows(replay[1])), ["value"], R.LONG_KEYS)


def test_stream_minutes_equal_batch(spark, replay, minute_rows, tmp_path):
    """With a watermark beyond the data's disorder every closed minute equals the batch one."""
    long = FL.explode_measures(ingest.raw_rows(stream_of(spark, replay)))
    root = str(tmp_path)
    run(windows.start_minute_rollup(long, root, checkpoint=str(tmp_path / "cp"), watermark="365 days", drain=True, name="none_closed"))
    assert not glob.glob(f"{root}/none_closed/*/*/*/*.parquet")
    # in complete mode nothing is held back
    counts = windows.with_bucket(windows.minute_windows(long, watermark=None), "minute")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("all_minutes").option(
        "checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    run(q)
    assert rows(spark.table("all_minutes")) == rows(minute_rows.select(*counts.columns))


def test_closed_minutes_land_once(spark, tmp_path):
    """Ordered rows, short watermark: all but the last minutes are closed and equal the batch rollup."""
    start = datetime(2024, 1, 1)
    data = [("s", "a", start + timedelta(seconds=20 * i), "v", float(i % 7), i) for i in range(900)]
    df = spark.createDataFrame(data, "sensor_name string, asset_id string, event_time timestamp, measure string, value double, arrival_order bigint")
    source = str(tmp_path / "in")
    for part in range(3):
        df.where((F.col("arrival_order") >= 300 * part) & (F.col("arrival_order") < 300 * (part + 1))).coalesce(1).write.mode(
            "append").parquet(source)
    stream = K.replay_stream(spark, source, 1, df.schema)
    root = str(tmp_path / "lake")
    run(windows.start_minute_rollup(stream, root, checkpoint=str(tmp_path / "cp"), watermark="5 minutes", drain=True))
    live = spark.read.parquet(f"{root}/minute_live")
    batch = R.minute_rollup(df, ["value"], R.LONG_KEYS)
    closed = batch.where(F.col("minute_bucket") < F.lit(start + timedelta(seconds=20 * 899) - timedelta(minutes=5, seconds=59)))
    assert live.count() == live.select("minute_bucket").distinct().count() >= closed.count() >= 290
    landed = live.select(batch.columns).join(closed.select("minute_bucket"), "minute_bucket", "left_semi")
    assert rows(landed.select(batch.columns)) == rows(closed)


def test_chained_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    data = [("s", "a", start + timedelta(minutes=10 * i), "v", float(i % 11), i) for i in range(6 * 24 * 4)]
    df = spark.createDataFrame(data, "sensor_name string, asset_id string, event_time timestamp, measure string, value double, arrival_order bigint")
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    stream = K.replay_stream(spark, source, None, df.schema)
    minutes = windows.minute_windows(stream, watermark="1 minute")
    days = windows.with_bucket(windows.day_windows(windows.hour_windows(minutes)), "day")
    q = days.writeStream.outputMode("append").format("memory").queryName("days").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run(q)
    batch = R.day_rollup(R.hour_rollup(R.minute_rollup(df, ["value"], R.LONG_KEYS), R.LONG_KEYS), R.LONG_KEYS)
    got = rows(spark.table("days").select(batch.columns))
    assert len(got) >= 2 and set(got) <= set(rows(batch))


def test_redelivery(spark, make_messages, tmp_path):
    m = make_messages(*[("t", i, "{}", utc(2024, 1, 1, 0, 0, i), 1) for i in range(10)])
    twice = m.unionByName(m)
    assert K.drop_redelivered(twice).count() == 10
    source = str(tmp_path / "in")
    twice.write.parquet(source)
    stream = K.replay_stream(spark, source)
    with pytest.raises(ValueError):
        K.drop_redelivered(stream)
    q = K.drop_redelivered(stream, "1 hour").writeStream.format("memory").queryName("once").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run(q)
    assert spark.table("once").count() == 10


def test_streams_into_one_root_keep_all_rows(spark, replay, tmp_path):
    """Two streams side by side, then one with a new checkpoint over the same hours."""
    root = str(tmp_path / "lake")
    views = F.col("topic").contains("view")
    for name, part in (("a", views), ("b", ~views), ("c", views)):
        run(ingest.start_ingest(stream_of(spark, replay).where(part), root, checkpoint=str(tmp_path / name), drain=True))
    accepted, all_ = ingest.raw_rows(replay[1]), replay[1]
    raw, refused = refresh.table(spark, root, "raw"), spark.read.parquet(f"{root}/rejects")
    again = accepted.where(views)
    assert raw.count() == accepted.count() + again.count()
    assert rows(raw.select("topic", "offset").distinct()) == rows(accepted.select("topic", "offset"))
    assert refused.count() + raw.count() == all_.count() + all_.where(views).count()


def test_extra_partitions(spark, replay, tmp_path):
    root = str(tmp_path / "lake")
    run(ingest.start_ingest(stream_of(spark, replay), root, checkpoint=str(tmp_path / "cp"), drain=True, extra_partitions=["topic"]))
    assert glob.glob(f"{root}/raw/event_date=*/event_hour=*/topic=*/ingest_batch=*")
    assert refresh.table(spark, root, "raw").count() == ingest.raw_rows(replay[1]).count()


def test_updated_minutes_equal_batch(spark, tmp_path):
    """In update mode every trigger lands what it changed; the last version of a minute is the batch row."""
    start = datetime(2024, 1, 1)
    data = [("s", "a", start + timedelta(seconds=20 * (i % 100)), "v", float(i % 7), i) for i in range(300)]
    df = spark.createDataFrame(data, "sensor_name string, asset_id string, event_time timestamp, measure string, value double, arrival_order bigint")
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    for part in range(3):
        df.where(F.floor(F.col("arrival_order") / 100) == part).coalesce(1).write.mode("append").parquet(source)
    run(windows.start_minute_rollup(
        K.replay_stream(spark, source, 1, df.schema), root, checkpoint=str(tmp_path / "cp"), watermark="1 hour",
        output_mode="update", drain=True, name="early"))
    batch = R.minute_rollup(df, ["value"], R.LONG_KEYS)
    landed = spark.read.parquet(f"{root}/early").withColumn("batch", F.substring_index("ingest_batch", "-", -1).cast("int"))
    keys = ["minute_bucket", *R.LONG_KEYS]
    columns = [c for c in batch.columns if c not in keys]
    last = landed.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("last")).select(*keys, "last.*")
    assert landed.count() > last.count()
    assert rows(last.select(*batch.columns)) == rows(batch)


def test_trigger_options():
    assert ingest.trigger_options(drain=True) == {"availableNow": True}
    assert ingest.trigger_options() == {"processingTime": "5 minutes"}


def test_redelivered_messages_land_once(spark, make_messages, tmp_path):
    source = tmp_path / "in"
    rows = [("sensor-data-a", i, f'{{"v":{i}}}', utc(2024, 1, 1, 0, 0, i)) for i in range(5)]
    make_messages(*rows, rows[2]).coalesce(1).write.mode("append").parquet(str(source))
    root, checkpoint = str(tmp_path / "lake"), str(tmp_path / "cp")
    land = lambda: run(ingest.start_ingest(K.replay_stream(spark, str(source)), root, checkpoint=checkpoint, drain=True, dedupe="10 minutes"))
    land()
    make_messages(*rows[3:], ("sensor-data-a", 9, '{"v":9}', utc(2024, 1, 1, 0, 1))).coalesce(1).write.mode("append").parquet(str(source))
    land()
    assert sorted(r.offset for r in refresh.table(spark, root, "raw").collect()) == [0, 1, 2, 3, 4, 9]


def test_update_mode_is_read_as_batch(spark, replay, tmp_path):
    """Minutes that several triggers have changed; batches 9 and 10 are told apart as numbers."""
    root = str(tmp_path / "lake")
    flat = lambda df: FL.explode_measures(ingest.raw_rows(df)).where("measure = 'value'")
    run(windows.start_minute_rollup(flat(stream_of(spark, replay, 1)), root, checkpoint=str(tmp_path / "cp"), watermark="40 days", output_mode="update", drain=True))
    stored = spark.read.parquet(f"{root}/minute_live")
    latest = windows.latest_minutes(stored)
    want = R.minute_rollup(flat(replay[1]), ["value"], R.LONG_KEYS)
    assert rows(latest.select(want.columns)) == rows(want)
    one = stored.limit(1).drop("ingest_batch")
    several = one.withColumns({"ingest_batch": F.lit("q-9"), "value_max": F.lit(9.0)}).unionByName(
        one.withColumns({"ingest_batch": F.lit("q-10"), "value_max": F.lit(10.0)}))
    assert [r.value_max for r in windows.latest_minutes(several).collect()] == [10.0]


def test_progress_becomes_metrics(spark, replay, tmp_path):
    path = str(tmp_path / "metrics")
    listener = record_progress(spark, path)
    try:
        query = run(ingest.start_ingest(stream_of(spark, replay, 3), str(tmp_path / "lake"), checkpoint=str(tmp_path / "cp"), drain=True, name="metered", dedupe="30 days"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(100):
            seen = spark.read.parquet(path).where("name = 'batch_id'").count() if os.path.exists(f"{path}/_SUCCESS") else 0
            if seen >= len(query.recentProgress):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.failed == 0
    stored = spark.read.parquet(path).where("series = 'query=metered'")
    last = {r.name: r.last_value for r in M.last_values(stored).collect()}
    raw, refused = (spark.read.parquet(f"{tmp_path}/lake/{name}").count() for name in ("raw", "rejects"))
    assert last["messages_consumed_total"] == raw and last["messages_failed_total"] == refused
    assert last["open_state_rows"] > 0 and last["open_state_bytes"] > 0 and last["last_message_time"] > 0
    assert stored.where("labels['query'] <> 'metered'").count() == 0
