"""Lake tables: layout, readers, writers, file listings."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake.functions import naming as N

# Interoperable LZ4; plain "lz4" would write Hadoop's own framing.
_CODECS = {"lz4": "lz4_raw"}

TIME_PARTITIONS = ("event_date", "event_hour")
COMPAT_PARTITIONS = ("asset_id", "year", "month", "day", "hour", "table_name")


def codec(compression: str) -> str:
    return _CODECS.get(compression, compression)


def with_time_partitions(df: DataFrame, time_col: str) -> DataFrame:
    return df.withColumn("event_date", F.date_format(time_col, "yyyy-MM-dd")).withColumn(
        "event_hour", F.date_format(time_col, "HH")
    )


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    sort_by: Sequence[str] = (),
    mode: str = "overwrite",
    compression: str = "lz4",
    max_rows_per_file: int | None = None,
) -> None:
    """Partitioned Parquet.

    ``overwrite`` replaces only the partitions present in ``df``, so a re-run writes the same
    result again. The rebalance hint gathers each partition's rows for few files, and adaptive
    execution splits a partition that is too large for one task. Files are as large as a task's
    share (``spark.sql.adaptive.advisoryPartitionSizeInBytes``) unless ``max_rows_per_file`` bounds
    them; a small bound makes very many files of a large table.
    """
    # what the sort compares stands together at the start of a row: it reads the rows in no order, and from memory
    first = list(dict.fromkeys((*partition_by, *sort_by)))
    placed = df.select(*first, *[c for c in df.columns if c not in first]).hint("rebalance", *[F.col(c) for c in partition_by])
    if sort_by:
        placed = placed.sortWithinPartitions(*partition_by, *sort_by)
    (
        placed.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", codec(compression))
        .option("maxRecordsPerFile", max_rows_per_file or 0)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_raw(
    rows: DataFrame, path: str, time_col: str = "event_time", extra_partitions: Sequence[str] = (), **options
) -> None:
    """Raw rows by date and hour, sorted so that row-group statistics select assets."""
    write_table(
        with_time_partitions(rows, time_col), path, (*TIME_PARTITIONS, *extra_partitions),
        sort_by=[c for c in ("asset_id", "sensor_name", time_col) if c not in extra_partitions], **options,
    )


def write_compat(rows: DataFrame, path: str, time_col: str = "event_time", **options) -> None:
    """``asset_id=…/year=…/…`` folders, for readers of partitioned tables that expect them.

    It makes a directory per asset, hour and table; prefer ``write_raw`` for many assets. Plain folders
    and exact file names are in ``documented``.
    """
    keyed = rows.select("*", *N.calendar_keys(F.col(time_col)))
    write_table(keyed, path, COMPAT_PARTITIONS, sort_by=[time_col], **options)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _folder(spark, path)
    return files.exists(place)


def read_folders(spark: SparkSession, path: str, schema: T.StructType, folders: Sequence[str]) -> DataFrame:
    """Only these partition folders of a table are listed and read; those that are absent are empty."""
    present = [f"{path}/{f}" for f in sorted(set(folders)) if exists(spark, f"{path}/{f}")]
    if not present:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*present)


def hour_slice(table: DataFrame, target: datetime) -> DataFrame:
    """Only the target hour's partition is read; for large tables ``read_folders`` also lists no other."""
    return table.where(
        (F.col("event_date") == target.strftime("%Y-%m-%d")) & (F.col("event_hour") == target.strftime("%H"))
    )


def day_slice(table: DataFrame, target: date) -> DataFrame:
    return table.where(F.col("event_date") == target.strftime("%Y-%m-%d"))


LISTED = "path string, rel_path string, size bigint, mtime timestamp, is_dir boolean"
#: Folders of files that are being written.
UNFINISHED = ("_temporary", ".spark-staging-", "_spark_metadata")
#: The engine's own small tables, below the root of a lake; no data.
BOOKKEEPING = "_engine"
#: Levels of folders that are dealt out anew before each task goes through all below its folders.
SPREAD_LEVELS = 3


def list_files(spark: SparkSession, root: str, pattern: str = "*.parquet", below: Sequence[str] = ("",),
               tasks: int | None = None) -> DataFrame:
    """Manifest of the tree below ``root``: path, rel_path, size and mtime; contents are not read.

    Executors list. The folders found on each of the first levels are dealt out over ``tasks`` (twice the
    cores by default) whatever their size in bytes; below, a task holds one folder's listing at a time.
    ``below`` are the folders to start from. Names that start with ``_`` or ``.`` are listed like others.
    What is absent is empty.
    """
    tasks = tasks or 2 * spark.sparkContext.defaultParallelism

    def listing(deep: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyarrow import fs

            files, base = filesystem(root)
            for batch in batches:
                todo = list(batch["rel_path"][batch["is_dir"].astype(bool)])
                while todo:
                    rel = todo.pop()
                    found = files.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/"), allow_not_found=True))
                    rows = [(f.path, f.path[len(base):].lstrip("/"), f.size, f.mtime, f.type == fs.FileType.Directory) for f in found]
                    rows = [r for r in rows if not r[1].rsplit("/", 1)[-1].startswith(UNFINISHED)]
                    if deep:
                        todo += [r[1] for r in rows if r[4]]
                        rows = [r for r in rows if not r[4]]
                    for at in range(0, len(rows), 10_000):
                        yield pd.DataFrame(rows[at:at + 10_000], columns=["path", "rel_path", "size", "mtime", "is_dir"]).astype(
                            {"size": "Int64", "mtime": "datetime64[us, UTC]"})
                yield batch[~batch["is_dir"].astype(bool)]
        return run

    start = spark.createDataFrame([(b.strip("/"),) for b in below], "rel_path string").selectExpr(
        "'' AS path", "rel_path", "CAST(NULL AS BIGINT) AS size", "CAST(NULL AS TIMESTAMP) AS mtime", "true AS is_dir")
    # a fixed number of partitions: adaptive execution would merge the few bytes of paths into one task
    if len(below) >= tasks:  # folders enough for all tasks
        found = start.repartition(tasks, "rel_path").mapInPandas(listing(True), LISTED)
    else:
        found = start.coalesce(1).mapInPandas(listing(False), LISTED)
        for level in range(SPREAD_LEVELS):
            found = found.repartition(tasks, "rel_path").mapInPandas(listing(level == SPREAD_LEVELS - 1), LISTED)
    name = re.escape(pattern).replace(r"\*", "[^/]*")
    return found.where(~F.col("is_dir") & F.col("rel_path").rlike(f"(^|/){name}$")).drop("is_dir")


def data_files(files: DataFrame) -> DataFrame:
    """Without the engine's own tables."""
    return files.where(~F.startswith("rel_path", F.lit(f"{BOOKKEEPING}/")))


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> list[str]:
    """What lies directly in a small folder."""
    files, place = _folder(spark, path)
    return [f"{path.rstrip('/')}/{status.getPath().getName()}" for status in files.listStatus(place)]


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete files or whole folders; what is gone already is no error."""
    for path in paths:
        files, place = _folder(spark, path)
        files.delete(place, True)


def filesystem(root: str):
    """File system and base path of a root: a URI (s3, gs, hdfs, file, …) or a local path."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root if ":" in root else os.path.abspath(root))
    return system, base.rstrip("/")


def sorted_files(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("path")


def manifest_parts(manifest: DataFrame) -> DataFrame:
    """Add tier (raw, aggregated, daily) and asset from the relative path."""
    parts = F.split("rel_path", "/")
    first = parts[0]
    tier = F.when(first.isin("aggregated", "daily"), first).otherwise(F.lit("raw"))
    asset = F.when(first.isin("aggregated", "daily"), F.try_element_at(parts, F.lit(2))).otherwise(first)
    return manifest.withColumns({"tier": tier, "asset_id": asset})


def asset_files(table: DataFrame, tier: str) -> DataFrame:
    """One row per file and asset of a table: tier, asset_id, and the asset's share of the file's size by rows."""
    rows = table.select("asset_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"))
    counted = rows.groupBy("file", "file_size", "asset_id").agg(F.count("*").alias("rows"))
    per_file = Window.partitionBy("file")
    share = F.col("file_size") * F.col("rows") / F.sum("rows").over(per_file)
    return counted.select(F.lit(tier).alias("tier"), "asset_id", "file", share.alias("size"))


def with_prefix(listing: DataFrame, prefix: str = "", column: str = "name") -> DataFrame:
    return listing.where(F.col(column).startswith(prefix)) if prefix else listing
