import os
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake.functions import naming as N
from gaugelake.operators import lifecycle as L
from gaugelake.sources import documented as D
from gaugelake.sources import lake


@pytest.fixture
def readings(spark):
    """Ten readings, one per minute, of two sensors on three assets."""
    rows = [
        (f"sensor_{i % 2}", f"{i % 3:03d}", datetime(2024, 1, 15, 10, i), float(i), f"quad_{i % 2}") for i in range(10)
    ]
    return spark.createDataFrame(rows, "sensor_name string, asset_id string, event_time timestamp, value double, table_name string")


def parquet_files(root):
    return [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")]


def test_raw_layout_and_codec(spark, readings, tmp_path):
    root = str(tmp_path / "raw")
    lake.write_raw(readings, root)
    files = parquet_files(root)
    assert files and all("/event_date=2024-01-15/event_hour=10/" in f for f in files)
    assert pq.ParquetFile(files[0]).metadata.row_group(0).column(0).compression.startswith("LZ4")
    back = lake.read_table(spark, root)
    assert back.count() == 10
    # directory names stay text
    assert dict(back.dtypes)["event_hour"] == "string"


@pytest.mark.parametrize("codec", ["lz4", "snappy", "zstd", "uncompressed"])
def test_codecs(readings, tmp_path, codec):
    root = str(tmp_path / codec)
    lake.write_raw(readings, root, compression=codec)
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in parquet_files(root)) == 10


def test_rows_per_file(readings, tmp_path):
    root = str(tmp_path / "raw")
    lake.write_raw(readings, root, max_rows_per_file=4)
    assert all(pq.ParquetFile(f).metadata.num_rows <= 4 for f in parquet_files(root))


def test_extra_partitions(readings, tmp_path):
    root = str(tmp_path / "raw")
    lake.write_raw(readings, root, extra_partitions=["table_name"])
    assert {f.split("table_name=")[1].split("/")[0] for f in parquet_files(root)} == {"quad_0", "quad_1"}


def test_compat_layout(spark, readings, tmp_path):
    root = str(tmp_path / "compat")
    lake.write_compat(readings, root)
    relative = [os.path.relpath(f, root).split("/") for f in parquet_files(root)]
    assert all(len(p) == 7 for p in relative)
    assert {p[0] for p in relative} == {"asset_id=000", "asset_id=001", "asset_id=002"}
    assert dict(lake.read_table(spark, root).dtypes)["asset_id"] == "string"


def test_overwrite_replaces_only_touched_partitions(spark, readings, tmp_path):
    root = str(tmp_path / "raw")
    lake.write_raw(readings, root)
    later = readings.withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 1 HOUR"))
    lake.write_raw(later, root)
    lake.write_raw(later, root)
    assert {r.event_hour: r["count"] for r in lake.read_table(spark, root).groupBy("event_hour").count().collect()} == {
        "10": 10, "11": 10}


def test_hour_and_day_slices_prune(spark, readings, tmp_path):
    root = str(tmp_path / "raw")
    lake.write_raw(readings, root)
    lake.write_raw(readings.withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 1 HOUR")), root)
    table = lake.read_table(spark, root)
    hour = lake.hour_slice(table, datetime(2024, 1, 15, 11))
    assert hour.count() == 10 and lake.day_slice(table, datetime(2024, 1, 15)).count() == 20
    assert "PartitionFilters: [isnotnull(event_date" in hour._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_listing(spark, readings, tmp_path):
    root = str(tmp_path / "raw")
    lake.write_raw(readings, root)
    (tmp_path / "raw" / "note.txt").write_text("x")
    listed = lake.sorted_files(lake.list_files(spark, root)).collect()
    assert [r.rel_path for r in listed] == sorted(os.path.relpath(f, root) for f in parquet_files(root))
    assert all(r.size == os.path.getsize(os.path.join(root, r.rel_path)) for r in listed)
    assert [r.rel_path for r in lake.list_files(spark, "file://" + root, "*.txt").collect()] == ["note.txt"]


def test_documented_files_from_elsewhere(spark, tmp_path):
    """Files that other programs wrote: with other columns, in other kinds."""
    def put(name, **columns):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table(columns), path)

    put("asset_001/2024/01/05/09/quad_ch1_20240105_09.parquet", value=[1.0, 2.0])
    put("_x/2024/01/05/09/_t_20240105_09.parquet", value=pa.array([3, 4], pa.int64()), note=["a", None], at=pa.array([datetime(2024, 1, 5)] * 2, pa.timestamp("ns")))
    put("007/2024/01/05/09/q_20240105_09.parquet", value=[5.5], note=pa.array([7], pa.int64()))
    put("other/readme.parquet", value=["no data"])
    rows = {(r.file_asset, r.file_year, r.file_month, r.file_day, r.file_hour, r.file_table, r.value, r.note, r["at"])
            for r in D.read_documented(spark, str(tmp_path)).collect()}
    day = ("2024", "01", "05", "09")
    assert rows == {("asset_001", *day, "quad_ch1", 1.0, None, None), ("asset_001", *day, "quad_ch1", 2.0, None, None),
                    ("_x", *day, "_t", 3.0, "a", datetime(2024, 1, 5)), ("_x", *day, "_t", 4.0, None, datetime(2024, 1, 5)),
                    ("007", *day, "q", 5.5, "7", None)}
    assert D.read_documented(spark, str(tmp_path), T.StructType.fromDDL("value double"), below=["007", "none"]).count() == 1


ODD_NAMES = ["line 1", "_x", "007", ".hidden", "a/b", "%", "100%", "..", "", "a=b", "q+r", "[s]*?{t}", "é"]


def test_documented_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(name, f"t{name}", datetime(2024, 1, 15, 10 + i % 2, i), float(i)) for name in ODD_NAMES for i in range(6)],
        "asset_id string, table_name string, event_time timestamp, value double").withColumn("measures", F.create_map(F.lit("v"), "value"))
    root = str(tmp_path / "out")
    want = sorted(map(str, rows.collect()))
    for _ in range(2):  # the second run replaces the files of the first
        written = D.write_raw_files(rows, root).collect()
        assert len(written) == 2 * len(ODD_NAMES) and {r.rows for r in written} == {3}
        assert sorted(os.path.relpath(f, root) for f in parquet_files(root)) == sorted(r.rel_path for r in written)
    assert os.path.exists(f"{root}/line 1/2024/01/15/10/tline 1_20240115_10.parquet") and os.path.exists(f"{root}/007/2024/01/15/11/t007_20240115_11.parquet")
    back = D.read_documented(spark, root, rows.schema)
    assert sorted(map(str, back.select(rows.columns).collect())) == want
    assert {(r.file_asset, r.file_table) for r in back.collect()} == {(n, f"t{n}") for n in ODD_NAMES}
    assert back.where("file_day <> '15' OR file_hour NOT IN ('10', '11')").count() == 0


def test_documented_reader_takes_partition_folders(spark, readings, tmp_path):
    root = str(tmp_path / "compat")
    named = readings.withColumn("asset_id", F.when(F.col("asset_id") == "000", "_x").when(F.col("asset_id") == "001", "line 1+:").otherwise(F.col("asset_id")))
    lake.write_compat(named, root)
    got = D.read_documented(spark, root)
    assert {(r.file_asset, r.file_table, r.file_hour, r.value) for r in got.collect()} == {
        (r.asset_id, r.table_name, "10", r.value) for r in named.collect()}


def test_a_broken_write_leaves_the_old_file(spark, readings, tmp_path):
    root = str(tmp_path / "out")
    D.write_raw_files(readings, root)
    before = sorted((f, os.path.getsize(f)) for f in parquet_files(root))
    broken = readings.withColumn("value", F.when(F.col("value") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("value") + 1))
    with pytest.raises(Exception, match="lost"):
        D.write_raw_files(broken, root)
    assert sorted(f for f, _ in before) == sorted(parquet_files(root))
    assert D.read_documented(spark, root).count() == 10
    assert not [f for _, _, fs in os.walk(root) for f in fs if f.endswith(".part")]


def test_rollup_files(spark, tmp_path):
    rows = [("s/1", "a", datetime(2024, 1, 15, h, 5), 1.0) for h in (3, 4)]
    minutes = spark.createDataFrame(rows, "sensor_name string, asset_id string, minute_bucket timestamp, v_mean double")
    names = {r.rel_path for level, df in (("minute", minutes), ("hour", minutes.withColumnRenamed("minute_bucket", "hour_bucket")),
                                          ("day", minutes.withColumnRenamed("minute_bucket", "day_bucket")))
             for r in D.write_rollup_files(df, str(tmp_path), level).collect()}
    assert names == {"aggregated/a/2024/01/15/03/s%2F1_minute.parquet", "aggregated/a/2024/01/15/04/s%2F1_minute.parquet",
                     "aggregated/a/2024/01/15/s%2F1_hour.parquet", "daily/a/2024/01/s%2F1_day.parquet"}


def test_storage_stats_by_tier(spark):
    manifest = spark.createDataFrame(
        [("a1/2024/01/01/00/x.parquet", 10), ("a1/2024/01/01/01/x.parquet", 20), ("a2/2024/01/01/00/x.parquet", 1),
         ("aggregated/a1/2024/01/01/00/s_minute.parquet", 5), ("daily/a1/2024/01/s_day.parquet", 3)],
        "rel_path string, size bigint")
    stats = {(r.tier, r.asset_id): (r.files, r.size_bytes) for r in L.storage_stats(lake.manifest_parts(manifest)).collect()}
    assert stats == {
        ("raw", "a1"): (2, 30), ("raw", "a2"): (1, 1), ("aggregated", "a1"): (1, 5), ("daily", "a1"): (1, 3),
        ("raw", "*"): (3, 31), ("aggregated", "*"): (1, 5), ("daily", "*"): (1, 3), ("*", "*"): (5, 39)}


def test_names_and_paths(spark):
    t = F.lit(datetime(2024, 1, 5, 9, 7)).cast("timestamp")
    r = spark.range(1).select(
        N.raw_file_path(F.lit("a"), t, F.lit("tab"), "/data/raw").alias("raw"),
        N.group_key(F.lit("a"), t, F.lit("tab")).alias("key"),
        N.rollup_file_path(F.lit("a"), t, F.lit("s"), "minute").alias("minute"),
        N.rollup_file_path(F.lit("a"), t, F.lit("s"), "hour").alias("hour"),
        N.rollup_file_path(F.lit("a"), t, F.lit("s"), "day").alias("day"),
        N.relative_path(F.lit("/data/raw/a\\b.parquet"), "/data/raw/").alias("inside"),
        N.relative_path(F.lit("/else/b.parquet"), "/data/raw").alias("outside"),
        N.strip_level_suffix(F.lit("s_hour_minute")).alias("stem"),
        N.megabytes(F.lit(1572864)).alias("mb"),
        N.iso_text(t + F.expr("INTERVAL 0.25 SECONDS")).alias("iso"),
    ).first().asDict()
    calendar = spark.range(1).select(*N.calendar_keys(t)).first().asDict()
    assert calendar == {"year": "2024", "month": "01", "day": "05", "hour": "09"}
    assert r == {
        "raw": "/data/raw/a/2024/01/05/09/tab_20240105_09.parquet", "key": "a/2024/01/05/09/tab",
        "minute": "aggregated/a/2024/01/05/09/s_minute.parquet", "hour": "aggregated/a/2024/01/05/s_hour.parquet",
        "day": "daily/a/2024/01/s_day.parquet", "inside": "a/b.parquet", "outside": "b.parquet", "stem": "s_hour",
        "mb": 1.5, "iso": "2024-01-05T09:07:00.250000",
    }


def test_what_the_sort_compares_starts_the_row(readings, tmp_path):
    lake.write_raw(readings, str(tmp_path))
    for file in parquet_files(tmp_path):
        names = pq.read_schema(file).names
        assert names[:3] == ["asset_id", "sensor_name", "event_time"] and sorted(names) == sorted(readings.columns)
