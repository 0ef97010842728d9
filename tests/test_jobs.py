import os
import pathlib
import shutil
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.operators import flatten as FL
from gaugelake.operators import lifecycle as L
from gaugelake.operators import rollup as R
from gaugelake.plans import jobs, ledger, tiers
from gaugelake.plans import queries as Q
from gaugelake.plans.refresh import RAW_SCHEMA, TABLES, hour_folders, refresh_new, refresh_rollups, table
from gaugelake.sources import documented, lake
from gaugelake.streaming.ingest import land_rows

T0 = datetime(2024, 1, 1)


@pytest.fixture
def lake_dirs(tmp_path):
    hot, cold = tmp_path / "hot", tmp_path / "cold"
    for i in range(40):
        f = hot / f"a{i % 4}" / "2024" / "01" / "15" / "10" / f"t_{i}.parquet"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * (100 + i))
    return str(hot), str(cold), str(tmp_path / "log")


def test_mirror_and_expire(spark, lake_dirs):
    hot, cold, log = lake_dirs
    assert jobs.mirror(spark, hot, cold, log).where("status = 'uploaded'").count() == 40
    assert jobs.mirror(spark, hot, cold, log).where("status = 'skipped'").count() == 40
    later = datetime.now() + timedelta(days=30)
    assert jobs.expire(spark, hot, log, later).where("status = 'would_delete'").count() == 40
    assert jobs.expire(spark, hot, log, datetime.now(), dry_run=False).count() == 0
    assert jobs.expire(spark, hot, log, later, dry_run=False).where("status = 'deleted'").count() == 40
    assert not [f for _, _, fs in os.walk(hot) for f in fs]
    assert jobs.expire(spark, hot, log, later, dry_run=False).count() == 0
    assert len([f for _, _, fs in os.walk(cold) for f in fs]) == 40


def test_stats(spark, lake_dirs):
    got = {(r.tier, r.asset_id): r.files for r in jobs.stats(spark, lake_dirs[0]).collect()}
    assert got[("*", "*")] == 40 and got[("raw", "a0")] == 10


def test_first_runs_need_no_folders(spark, tmp_path):
    hot = str(tmp_path / "none")
    assert jobs.mirror(spark, hot, str(tmp_path / "cold"), str(tmp_path / "log")).count() == 0
    assert jobs.expire(spark, hot, str(tmp_path / "no_log"), datetime.now()).count() == 0


def sensor_rows(spark, seconds, batch):
    rows = spark.createDataFrame(
        [("s", "t", asset, T0 + timedelta(seconds=s), float(s), s) for s in seconds for asset in ("line 1", "_x", "007")],
        "sensor_name string, table_name string, asset_id string, event_time timestamp, v double, arrival_order bigint")
    return rows.select(
        "*", F.create_map(F.lit("v"), "v").alias("measures"), F.lit(batch).alias("ingest_batch"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA
          if f.name not in (*rows.columns, "measures", "ingest_batch", "event_date", "event_hour")])


def small_lake(spark, root, seconds, batch, **options):
    rows = sensor_rows(spark, seconds, batch)
    land_rows(lake.with_time_partitions(rows, "event_time").select(*RAW_SCHEMA.fieldNames()), root, **options)


def test_mirror_equals_source_and_late_rows_keep_the_hour(spark, tmp_path):
    root, cold, log = (str(tmp_path / n) for n in ("hot", "cold", "log"))
    small_lake(spark, root, range(0, 300, 10), "q-0")
    changes = 0
    for _ in range(3):
        refresh_rollups(spark, root, T0)
        changes += jobs.mirror(spark, root, cold, log).where("status IN ('uploaded', 'deleted')").count()
        for name in ("raw", "minute", "hour", "day"):
            assert table(spark, root, name).count() == table(spark, cold, name).count() > 0
        assert jobs.read_log(spark, log).count() == changes
    assert jobs.mirror(spark, root, cold, log).where("status <> 'skipped'").count() == 0
    assert jobs.read_log(spark, log).count() == changes
    whole = sorted(map(str, table(spark, root, "minute").drop("value_mean", "value_max").collect()))

    # raw files expire, then one late row comes
    assert jobs.expire(spark, root, log, datetime.now() + timedelta(days=30), dry_run=False).where("rel_path LIKE 'raw/%'").count()
    refresh_new_hours = lambda **kw: refresh_new(spark, root, **kw)
    small_lake(spark, root, [5], "q-1")
    deleted = L.gone(jobs.read_log(spark, log))
    with pytest.raises(ValueError):
        refresh_new_hours(deleted=deleted)
    assert refresh_new_hours(cold=cold, deleted=deleted) == [T0]
    got = table(spark, root, "minute")
    assert sorted(map(str, got.drop("value_mean", "value_max").collect())) == whole
    assert got.where("minute_bucket = timestamp '2024-01-01 00:00:00'").first().value_mean == (0 + 10 + 20 + 30 + 40 + 50 + 5) / 7
    assert refresh_new_hours(cold=cold, deleted=deleted) == []
    jobs.mirror(spark, root, cold, log)
    assert table(spark, cold, "raw").count() == 93
    totals = {(r.tier, r.asset_id): (r.files, r.size_bytes) for r in jobs.stats(spark, root).collect()}
    assert {asset for _, asset in totals} == {"line 1", "_x", "007", "*"}
    files = lake.data_files(lake.list_files(spark, root)).collect()
    assert totals["*", "*"] == (len(files), sum(f.size for f in files))
    assert totals["raw", "*"][0] == sum(f.rel_path.startswith("raw/") for f in files)


FUTURE = datetime.now() + timedelta(days=60)


def expire_all(spark, root, log):
    return jobs.expire(spark, root, log, FUTURE, dry_run=False)


def rolled(spark, root, cold, batches):
    """What every level of the lake says, and what a rollup of all rows that ever landed says."""
    rows = reduce(DataFrame.unionByName, [sensor_rows(spark, seconds, batch) for batch, seconds in batches])
    minutes = R.minute_rollup(FL.explode_measures(rows), ["value"], R.LONG_KEYS)
    hours = R.hour_rollup(minutes, R.LONG_KEYS)
    want = {"minute": minutes, "hour": hours, "day": R.day_rollup(hours, R.LONG_KEYS)}
    days = sorted({(T0 + timedelta(seconds=s)).strftime("event_date=%Y-%m-%d") for _, seconds in batches for s in seconds})
    for name, df in want.items():
        stored = tiers.rows(spark, root, cold, name, TABLES[name], days).select(*df.columns)
        yield name, sorted(map(str, Q.rounded(stored, 6).collect())), sorted(map(str, Q.rounded(df, 6).collect()))


HOUR = 3600


def test_every_level_is_complete_after_expiry(spark, tmp_path):
    """Three hours on two days land, are mirrored and expire in all tables; then late rows come."""
    root, cold, log = (str(tmp_path / n) for n in ("hot", "cold", "log"))
    landed = [("q-0", range(0, 600, 60)), ("q-1", range(2 * HOUR, 2 * HOUR + 300, 60)), ("q-2", range(25 * HOUR, 25 * HOUR + 300, 30))]
    for batch, seconds in landed:
        small_lake(spark, root, seconds, batch)
    assert refresh_new(spark, root) == [T0, T0 + timedelta(hours=2), T0 + timedelta(hours=25)]
    # a cold tier that has nothing yet changes nothing, neither has an hour that never was
    refresh_rollups(spark, root, [T0, T0 + timedelta(days=90)], cold=cold, deleted=L.gone(jobs.read_log(spark, log)))
    jobs.mirror(spark, root, cold, log)
    assert expire_all(spark, root, log).where("status = 'deleted'").count() > 10
    assert not lake.data_files(lake.list_files(spark, root)).count()
    assert lake.list_files(spark, root).count()  # the ledger is still there
    for _, got, want in rolled(spark, root, cold, landed):
        assert got == want

    for batch, seconds in (("q-3", [HOUR * 2 + 7]), ("q-4", [5, 24 * HOUR + 1])):
        landed.append((batch, seconds))
        small_lake(spark, root, seconds, batch)
        gone = L.gone(jobs.read_log(spark, log))
        with pytest.raises(ValueError, match="expired"):
            refresh_new(spark, root, deleted=gone)
        with pytest.raises(ValueError, match="expired"):
            refresh_new(spark, root, level="daily", deleted=gone)
        assert refresh_new(spark, root, cold=cold, deleted=gone) == [datetime(2024, 1, 1) + timedelta(hours=s // HOUR) for s in seconds]
        for name, got, want in rolled(spark, root, cold, landed):
            assert got == want, name
        jobs.mirror(spark, root, cold, log)
        for name, got, want in rolled(spark, root, cold, landed):
            assert got == want, name
        expire_all(spark, root, log)
    for name, got, want in rolled(spark, root, cold, landed):
        assert got == want, name
    # the cold tier alone is complete too
    for name, got, want in rolled(spark, str(tmp_path / "none"), cold, landed):
        assert got == want, name


def test_a_part_of_a_folder_expires(spark, tmp_path):
    root, cold, log = (str(tmp_path / n) for n in ("hot", "cold", "log"))
    small_lake(spark, root, range(0, 7200, 60), "q-0", max_rows_per_file=40)
    jobs.mirror(spark, root, cold, log)
    files = sorted(r.path for r in lake.list_files(spark, f"{root}/raw").collect())
    assert len(files) >= 6
    for path in files[::2]:
        os.utime(path, (0, 0))
    assert jobs.expire(spark, root, log, datetime(1990, 1, 1), dry_run=False, tables=["hour", "minute"]).count() == 0
    assert jobs.expire(spark, root, log, datetime(1990, 1, 1), dry_run=False, tables=["raw"]).count() == len(files[::2])
    folders = hour_folders([T0, T0 + timedelta(hours=1)])
    gone = L.gone(jobs.read_log(spark, log))
    assert tiers.rows(spark, root, cold, "raw", RAW_SCHEMA, folders, gone).count() == 360
    # another generation of a folder replaces what has expired of it
    small_lake(spark, root, range(0, 3600, 60), "q-0")
    assert tiers.rows(spark, root, cold, "raw", RAW_SCHEMA, folders, gone).count() == 360
    assert tiers.rows(spark, root, None, "raw", RAW_SCHEMA, folders[:1], gone).count() == 180
    jobs.mirror(spark, root, cold, log)
    assert tiers.rows(spark, root, cold, "raw", RAW_SCHEMA, folders, gone).count() == 360
    # the cold copy of a lost file is lost as well
    shutil.rmtree(f"{cold}/raw/{folders[1]}")
    with pytest.raises(ValueError, match="expired"):
        tiers.rows(spark, root, cold, "raw", RAW_SCHEMA, folders, gone)


def test_refresh_opens_no_raw_file_of_other_hours(spark, tmp_path):
    root = str(tmp_path)
    small_lake(spark, root, [0, 2 * HOUR], "q-0")
    assert refresh_new(spark, root) == [T0, T0 + timedelta(hours=2)] and refresh_new(spark, root) == []
    entries = {(r.event_hour, r.ingest_batch): (r.files, r.rows) for r in ledger.landed(spark, root).collect()}
    assert entries == {("00", "q-0"): (1, 3), ("02", "q-0"): (1, 3)}
    # hours that cannot be read any more do not matter to later refreshes
    for f in (tmp_path / "raw" / "event_date=2024-01-01" / "event_hour=00").rglob("*.parquet"):
        f.write_bytes(b"no parquet")
    small_lake(spark, root, [2 * HOUR + 1], "q-1")
    todo = ledger.unrefreshed(spark, root)
    assert all("/unrefreshed-" in f for f in todo.inputFiles())
    assert refresh_new(spark, root) == [T0 + timedelta(hours=2)]
    # a batch that is repeated is one entry, and is not refreshed again
    small_lake(spark, root, [2 * HOUR + 1], "q-1")
    assert ledger.landed(spark, root).count() == 3 and refresh_new(spark, root) == []
    ledger.tidy(spark, root)
    assert len(list((tmp_path / "_engine" / "landed").glob("*.parquet"))) == 1
    assert ledger.landed(spark, root).count() == 3 and refresh_new(spark, root) == []


def test_ledger_of_a_lake_without_one(spark, tmp_path):
    root = str(tmp_path)
    small_lake(spark, root, [0, HOUR], "q-0")
    shutil.rmtree(f"{root}/_engine")
    ledger.rebuild(spark, root, datetime(2024, 1, 2))
    ledger.rebuild(spark, root, datetime(2024, 1, 2))
    assert {(r.event_hour, r.ingest_batch, r.files) for r in ledger.landed(spark, root).collect()} == {("00", "q-0", 1), ("01", "q-0", 1)}
    assert refresh_new(spark, root) == [T0, T0 + timedelta(hours=1)]


def copies(cold, pattern="*.parquet"):
    return sorted(str(p.relative_to(cold)) for p in pathlib.Path(cold).rglob(pattern))


def test_a_failed_copy_keeps_the_old_ones(spark, tmp_path):
    """Two new generations; of one a file cannot be copied."""
    root, cold, log = (str(tmp_path / n) for n in ("hot", "cold", "log"))
    small_lake(spark, root, range(0, 7200, 60), "q-0", max_rows_per_file=50)
    jobs.mirror(spark, root, cold, log)
    before = copies(cold)
    small_lake(spark, root, range(0, 7200, 60), "q-0", max_rows_per_file=50)
    hour_0 = sorted((pathlib.Path(root) / "raw" / "event_date=2024-01-01" / "event_hour=00").rglob("*.parquet"))
    blocked = pathlib.Path(cold) / hour_0[-1].relative_to(root)
    blocked.mkdir()  # a folder of that name: the file cannot be put there
    (blocked / "x").write_text("")
    results = jobs.mirror(spark, root, cold, log, retries=1, retry_delay_s=0)
    assert [r.rel_path for r in results.where("status = 'failed'").collect()] == [str(hour_0[-1].relative_to(root))]
    now = copies(cold)
    assert {f for f in before if "event_hour=00" in f} <= set(now)
    assert not {f for f in before if "event_hour=01" in f} & set(now)
    assert not copies(cold, "*.part")
    (blocked / "x").unlink()
    blocked.rmdir()
    left_over = blocked.with_name("lost.parquet.1.part")
    left_over.write_text("1")
    jobs.mirror(spark, root, cold, log)
    assert left_over.exists()  # another run may be writing it
    os.utime(left_over, (0, 0))
    swept = jobs.mirror(spark, root, cold, log).where("reason = 'left_over'")
    assert swept.count() == 1 and not left_over.exists()
    assert table(spark, cold, "raw").count() == table(spark, root, "raw").count() == 360
    assert copies(cold) == copies(root, "raw/**/*.parquet")


def test_a_crash_between_delete_and_log_keeps_the_copies(spark, tmp_path, monkeypatch):
    root, cold, log = (str(tmp_path / n) for n in ("hot", "cold", "log"))
    small_lake(spark, root, range(0, 3600, 60), "q-0", max_rows_per_file=50)
    jobs.mirror(spark, root, cold, log)
    before = copies(cold)
    files = sorted((pathlib.Path(root) / "raw").rglob("*.parquet"))
    os.utime(files[0], (0, 0))

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(L, "log_entries", broken)
        with pytest.raises(RuntimeError):
            jobs.expire(spark, root, log, datetime(1990, 1, 1), dry_run=False)
    assert not files[0].exists() and files[1].exists()
    assert [r.rel_path for r in L.gone(jobs.read_log(spark, log)).collect()] == [str(files[0].relative_to(root))]
    jobs.mirror(spark, root, cold, log)
    assert copies(cold) == before
    gone = L.gone(jobs.read_log(spark, log))
    with pytest.raises(ValueError):
        refresh_rollups(spark, root, T0, deleted=gone)
    refresh_rollups(spark, root, T0, cold=cold, deleted=gone)
    assert table(spark, root, "minute").count() == 180


def test_listing_is_spread(spark, tmp_path):
    for i in range(300):
        f = tmp_path / "raw" / f"event_date=d{i:03d}" / "event_hour=00" / "ingest_batch=b" / "f.parquet"
        f.parent.mkdir(parents=True)
        f.write_bytes(b"1")
    listed = lake.list_files(spark, str(tmp_path))
    per_task = listed.groupBy(F.spark_partition_id().alias("task")).count()
    rows = listed.select(F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 300 and len({r.task for r in rows}) >= 6 and per_task.count() >= 6
    assert lake.list_files(spark, str(tmp_path), below=["raw/event_date=d007", "raw/none"]).count() == 1


def test_listing_shows_all_names(spark, tmp_path):
    for name in ("_x/a.parquet", ".y/b/c/d.parquet", "e.parquet", "f/_temporary/0/g.parquet", "f/h.txt", "line 1/i+j.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1234")
    got = {(r.rel_path, r.size) for r in lake.list_files(spark, str(tmp_path)).collect()}
    assert got == {(n, 4) for n in ("_x/a.parquet", ".y/b/c/d.parquet", "e.parquet", "line 1/i+j.parquet")}


def test_status_and_health(spark, tmp_path):
    root, cold, log, metrics = (str(tmp_path / n) for n in ("hot", "cold", "log", "metrics"))
    small_lake(spark, root, range(0, 7200, 60), "q-0")
    first = {r.name: r.value for r in jobs.status(spark, root, log, metrics, T0 + timedelta(hours=3)).collect()}
    assert first["files_pending_upload"] == first["storage_files"] == first["landed_files"] == 2 and first["landed_rows"] == 360
    assert first["bytes_pending_upload"] == first["storage_used_bytes"] > 0 and "rollup_delay_seconds" not in first
    refresh_new(spark, root)
    jobs.mirror(spark, root, cold, log)
    used = int(first["storage_used_bytes"])
    second = {r.name: r.value for r in jobs.status(spark, root, log, metrics, T0 + timedelta(hours=4), capacity_bytes=used).collect()}
    assert second["files_pending_upload"] == 0 and second["rollup_delay_seconds"] == 7200 and second["storage_usage"] > 1
    table_ = spark.read.schema(jobs.METRICS_SCHEMA).parquet(metrics)
    found = {r.component: (r.healthy, r.issues) for r in jobs.health(table_, T0 + timedelta(hours=4)).collect()}
    assert found == {"ingest": (None, []), "rollup": (True, []), "upload": (True, []), "storage": (False, ["storage_usage"]),
                     "overall": (False, ["storage_usage"])}
    # hours later: the rollups are late, and no message has come
    late = spark.createDataFrame([(T0 + timedelta(hours=4), "last_message_time", {"query": "q"}, "query=q", T0.timestamp(), None)], jobs.METRICS_SCHEMA)
    jobs.status(spark, root, log, metrics, T0 + timedelta(hours=9))
    found = {r.component: (r.healthy, r.issues) for r in jobs.health(spark.read.schema(jobs.METRICS_SCHEMA).parquet(metrics).unionByName(late), T0 + timedelta(hours=9)).collect()}
    assert found["ingest"] == (False, ["last_message_time of query=q"]) and not found["rollup"][0] and not found["overall"][0]
    assert [r.healthy for r in jobs.health(late.limit(0), T0).where("component = 'overall'").collect()] == [True]
    empty = str(tmp_path / "none")
    assert {r.value for r in jobs.status(spark, empty, log, str(tmp_path / "m2"), T0).collect()} == {0.0}


def test_export_follows_the_documented_names(spark, tmp_path):
    root, out = str(tmp_path / "hot"), str(tmp_path / "out")
    small_lake(spark, root, [0, 60, 3600], "q-0")
    refresh_new(spark, root)
    names = {r.rel_path for r in jobs.export(spark, root, out, [T0, T0 + timedelta(hours=1)]).collect()}
    assert {"line 1/2024/01/01/00/t_20240101_00.parquet", "_x/2024/01/01/01/t_20240101_01.parquet", "aggregated/007/2024/01/01/00/s_minute.parquet",
            "aggregated/_x/2024/01/01/s_hour.parquet", "daily/line 1/2024/01/s_day.parquet"} <= names and len(names) == 18
    back = documented.read_documented(spark, out)
    assert sorted((r.file_asset, r.file_hour, r.sensor_name, r.event_time) for r in back.collect()) == sorted(
        (a, f"{h:02d}", "s", T0 + timedelta(hours=h, minutes=m)) for a in ("line 1", "_x", "007") for h, m in ((0, 0), (0, 1), (1, 0)))


def test_command_line():
    args = jobs._arguments().parse_args(["refresh", "--root", "r", "--hour", "2024-01-15T10", "--hour", "2024-01-15T11"])
    assert args.hour == [datetime(2024, 1, 15, 10), datetime(2024, 1, 15, 11)] and args.level == "both"
    assert not jobs._arguments().parse_args(["expire", "--root", "r", "--log", "l"]).delete
    with pytest.raises(SystemExit):
        jobs._arguments().parse_args(["refresh", "--root", "r"])


def test_landing_observes_plain_columns(spark, tmp_path, monkeypatch):
    root, seen, write = str(tmp_path), [], lake.write_table
    monkeypatch.setattr(lake, "write_table", lambda df, *args, **options: (seen.append(df), write(df, *args, **options)))
    small_lake(spark, root, (0, 3600), "q-0")
    (line,) = [x for x in seen[0]._jdf.queryExecution().analyzed().toString().splitlines() if "CollectMetrics" in x]
    assert "collect_set" in line and "struct(" not in line and "concat" not in line
    landed = ledger.landed(spark, root).collect()
    assert sorted((r.event_hour, r.ingest_batch, r.rows) for r in landed) == [
        (f"{(T0 + timedelta(hours=h)).hour:02d}", "q-0", 3) for h in (0, 1)]
