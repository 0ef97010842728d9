"""Compaction of the raw table."""

import os
import shutil
from datetime import datetime, timedelta

import pytest

from gaugelake.plans import compact as C
from gaugelake.plans import jobs, ledger, tiers
from gaugelake.plans.refresh import RAW_SCHEMA, hour_folders, refresh_new, refresh_rollups, table
from gaugelake.sources import lake
from test_jobs import T0, rolled, small_lake

LATER = datetime(2024, 2, 1)
HOURS = hour_folders([T0, T0 + timedelta(hours=1)])


def contents(df):
    return sorted(map(str, df.drop("ingest_batch").collect()))


def n_files(spark, root):
    return lake.list_files(spark, f"{root}/raw").count()


@pytest.fixture
def many_batches(spark, tmp_path):
    root = str(tmp_path / "hot")
    landed = [(f"q-{i}", [i, 3600 + i] if i % 2 else [i]) for i in range(4)]
    for batch, seconds in landed:
        small_lake(spark, root, seconds, batch)
    refresh_new(spark, root)
    return root, landed


def test_bins(spark):
    files = [("a", 30), ("a", 30), ("b", 50), ("c", 45), ("d", 200), ("e", 10)]
    rows = [(f"event_date=x/event_hour=00/ingest_batch={f}", size) for f, size in files] + [
        ("event_date=x/event_hour=01/ingest_batch=a", 10), ("event_date=x/event_hour=02/ingest_batch=a", 20), ("event_date=x/event_hour=02/ingest_batch=b", 5),
        ("event_date=x/event_hour=03/other=1/ingest_batch=a", 1), ("event_date=x/event_hour=03/other=1/ingest_batch=b", 1)]
    got = {(r.hour[-2:], r.folder[-1]): r.bin for r in C.bins(spark.createDataFrame(rows, "folder string, size bigint"), 120).collect()}
    assert got == {("00", "a"): 0, ("00", "b"): 0, ("00", "c"): 0, ("00", "e"): 1, ("02", "a"): 0, ("02", "b"): 0}


def test_rows_stay_and_files_go(spark, many_batches, tmp_path):
    root, landed = many_batches
    cold, log = str(tmp_path / "cold"), str(tmp_path / "log")
    jobs.mirror(spark, root, cold, log)
    before, files = contents(table(spark, root, "raw")), n_files(spark, root)
    assert C.compact(spark, root, T0) == 0  # no hour is over
    assert C.compact(spark, root, LATER, hours=[T0 + timedelta(hours=1)]) == 2
    assert C.compact(spark, root, LATER) == 4
    assert n_files(spark, root) == 2 < files
    assert contents(table(spark, root, "raw")) == before == contents(tiers.raw_table(spark, root, RAW_SCHEMA))
    again = sorted(r.path for r in lake.list_files(spark, f"{root}/raw").collect())
    assert C.compact(spark, root, LATER) == 0 and sorted(r.path for r in lake.list_files(spark, f"{root}/raw").collect()) == again
    # the cold tier still has the replaced files: nothing counts twice, before and after they are retired
    for _ in range(2):
        assert contents(tiers.rows(spark, root, cold, "raw", RAW_SCHEMA, HOURS)) == before
        jobs.mirror(spark, root, cold, log)
    assert contents(table(spark, cold, "raw")) == before
    # nothing landed, so nothing is refreshed; late rows are, and are compacted in their turn
    assert refresh_new(spark, root) == []
    landed.append(("q-9", [7]))
    small_lake(spark, root, [7], "q-9")
    assert C.compact(spark, root, LATER) == 0  # the hour waits for its refresh
    assert refresh_new(spark, root, cold=cold) == [T0]
    for name, got, want in rolled(spark, root, cold, landed):
        assert got == want, name
    assert C.compact(spark, root, LATER) == 2
    jobs.mirror(spark, root, cold, log)
    assert contents(table(spark, cold, "raw")) == contents(table(spark, root, "raw"))
    assert len(contents(table(spark, root, "raw"))) == len(before) + 3
    # compacted files expire like others
    jobs.expire(spark, root, log, datetime.now() + timedelta(days=60), dry_run=False)
    refresh_rollups(spark, root, [T0, T0 + timedelta(hours=1)], cold=cold)
    for name, got, want in rolled(spark, root, cold, landed):
        assert got == want, name


@pytest.mark.parametrize("broken", ["before the swap", "after the swap"])
def test_a_compaction_that_breaks_off(spark, many_batches, monkeypatch, broken):
    root, landed = many_batches
    before = contents(table(spark, root, "raw"))

    def lost(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        if broken == "before the swap":
            patch.setattr(C.ledger, "append", lost)
        else:
            patch.setattr(C.J, "run_delete", lost)
        with pytest.raises(RuntimeError):
            C.compact(spark, root, LATER)
    assert len(contents(table(spark, root, "raw"))) == 2 * len(before)  # old and new files are both there
    assert contents(tiers.rows(spark, root, None, "raw", RAW_SCHEMA, HOURS, None)) == before or broken == "before the swap"
    if broken == "before the swap":
        assert C.sweep(spark, root) == 2 and contents(table(spark, root, "raw")) == before
    assert C.compact(spark, root, LATER) == (6 if broken == "before the swap" else 0)
    assert contents(table(spark, root, "raw")) == before
    assert n_files(spark, root) == 2


def test_a_repeated_batch_of_a_compacted_hour_counts_once(spark, many_batches):
    """A stream that lost its last commit lands a batch again that was compacted in between."""
    root, landed = many_batches
    C.compact(spark, root, LATER)
    small_lake(spark, root, landed[-1][1], landed[-1][0])
    refresh_rollups(spark, root, [T0, T0 + timedelta(hours=1)])
    for name, got, want in rolled(spark, root, None, landed):
        assert got == want, name
    assert len(contents(tiers.raw_table(spark, root, RAW_SCHEMA))) == 18
    C.compact(spark, root, LATER)
    assert len(contents(table(spark, root, "raw"))) == 18


def test_no_lake(spark, tmp_path):
    assert C.compact(spark, str(tmp_path / "none"), LATER) == 0
    assert not os.path.exists(tmp_path / "none") or not shutil.rmtree(tmp_path / "none")
    assert ledger.landed(spark, str(tmp_path / "none")).count() == 0
