"""Files under exact names: the layout ``asset/yyyy/mm/dd/hh/table_yyyymmdd_hh.parquet`` and its rollups.

Spark chooses the names of its files and passes over those that start with ``_`` or ``.``, so tasks write and
read these files themselves. Rows are dealt out by their file and sorted, so a task streams one file after
the other: it writes a part next to its target and renames it when it is complete. A task that is repeated
makes the same files again; what a lost one leaves are parts, which no reader takes for data.

Names are the values themselves, but for what cannot be one part of a path: ``/`` and ``%`` are written
``%2F`` and ``%25``, the values ``.``, ``..`` and empty as ``%2E``, ``%2E%2E`` and ``%``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

from gaugelake.functions import naming as N
from gaugelake.operators.filejobs import in_tasks, snapshot
from gaugelake.sources.lake import filesystem, list_files

WRITTEN = "rel_path string, rows bigint, size bigint"
ROWS_PER_GROUP = 100_000

#: asset, year, month, day, hour and table, plain or as ``key=value`` folders.
PLACE = (r"^(?:.*/)?(?:asset_id=)?([^/]+)/(?:year=)?(\d{4})/(?:month=)?(\d{2})/(?:day=)?(\d{2})/(?:hour=)?(\d{2})/"
         r"(?:table_name=([^/]+)/[^/]+|([^/]+)_\d{8}_\d{2})\.parquet$")


def path_part(value: Column) -> Column:
    whole = F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return F.when(value == "", "%").when(value == ".", "%2E").when(value == "..", "%2E%2E").otherwise(whole)


def value_of(part: Column) -> Column:
    """What ``path_part`` (or Spark, in names of partition folders) has written."""
    plus = F.replace(part, F.lit("+"), F.lit("%2B"))
    return F.when(part == "%", "").otherwise(F.coalesce(F.try_url_decode(plus), part))


def write_files(rows: DataFrame, root: str, path: Column, sort_by: Sequence[str] = (), compression: str = "lz4") -> DataFrame:
    """Write ``rows`` to one Parquet file for each ``path`` (below ``root``), replacing it; returns path, rows and size.

    A file is one task's work, whatever its size; the task holds ``ROWS_PER_GROUP`` rows of it.
    """
    placed = rows.withColumn("__path", path).repartition("__path").sortWithinPartitions("__path", *sort_by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, base = filesystem(root)
        rel = writer = part = None
        held: list[pa.RecordBatch] = []
        done = 0

        def flush() -> None:
            nonlocal held
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=ROWS_PER_GROUP)
                held = []

        def finished() -> pa.RecordBatch:
            flush()
            writer.close()
            files.move(part, f"{base}/{rel}")
            return pa.RecordBatch.from_pydict({"rel_path": [rel], "rows": [done], "size": [files.get_file_info(f"{base}/{rel}").size]})

        try:
            for batch in batches:
                names = batch["__path"].to_pylist()
                body, at = batch.drop_columns(["__path"]), 0
                for name, run in groupby(names):
                    n = sum(1 for _ in run)
                    if name != rel:
                        if writer is not None:
                            yield finished()
                        rel, done, part = name, 0, f"{base}/{name}.{uuid.uuid4().hex}.part"
                        files.create_dir(part.rsplit("/", 1)[0], recursive=True)
                        writer = pq.ParquetWriter(part, body.schema, filesystem=files, compression=compression)
                    held.append(body.slice(at, n))
                    done, at = done + n, at + n
                    if sum(b.num_rows for b in held) >= ROWS_PER_GROUP:
                        flush()
            if writer is not None:
                yield finished()
                part = None
        finally:
            if part is not None and files.get_file_info(part).type == fs.FileType.File:
                files.delete_file(part)

    return snapshot(placed.mapInArrow(write, WRITTEN), "written")


def write_raw_files(rows: DataFrame, root: str, time_col: str = "event_time", **options) -> DataFrame:
    """Raw rows by asset, hour and table."""
    path = N.raw_file_path(path_part(F.col("asset_id")), F.col(time_col), path_part(F.col("table_name")))
    return write_files(rows, root, path, sort_by=[time_col], **options)


def write_rollup_files(rollup: DataFrame, root: str, level: str, **options) -> DataFrame:
    """Minute, hour or day rollups by asset and sensor."""
    bucket = f"{level}_bucket"
    path = N.rollup_file_path(path_part(F.col("asset_id")), F.col(bucket), path_part(F.col("sensor_name")), level)
    return write_files(rollup, root, path, sort_by=[bucket], **options)


def columns_of(files: DataFrame, root: str) -> T.StructType:
    """All columns that any of the files has; kinds that differ become DOUBLE (numbers) or STRING.

    Footers are read on executors; one row for each column and kind reaches the driver.
    """
    def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        system, base = filesystem(root)
        for batch in batches:
            found = {(f.name, "void" if pa.types.is_null(f.type) else from_arrow_type(f.type).simpleString())
                     for rel in batch["rel_path"] for f in pq.read_schema(f"{base}/{rel}", filesystem=system)}
            yield pd.DataFrame(sorted(found), columns=["name", "kind"], dtype=object)

    by_name: dict[str, set[str]] = {}
    for row in in_tasks(files.select("rel_path", "size")).mapInPandas(kinds, "name string, kind string").distinct().collect():
        by_name.setdefault(row["name"], set()).add(row["kind"])
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    fields = []
    for name in sorted(by_name):
        own = by_name[name] - {"void"}
        kind = own.pop() if len(own) == 1 else "double" if own and own <= numbers else "string"
        fields.append(f"{N.quote(name)} {'timestamp' if kind == 'timestamp_ntz' else kind}")
    return T.StructType.fromDDL(", ".join(fields)) if fields else T.StructType([])


def read_files(files: DataFrame, root: str, schema: T.StructType) -> DataFrame:
    """Rows of the listed files (``rel_path``, ``size``) with their ``rel_path``, whatever the names look like.

    Columns that a file lacks are NULL there; what does not fit the wanted kind becomes its text.
    """
    names = schema.fieldNames()
    wanted = to_arrow_schema(schema)
    out = T.StructType([*schema.fields, T.StructField("rel_path", T.StringType())])

    def fitted(column: pa.Array, kind: pa.DataType) -> pa.Array:
        try:
            return column.cast(kind)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            return pa.array([None if v is None else v if isinstance(v, str) else json.dumps(v, default=str) for v in column.to_pylist()], pa.string()).cast(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, base = filesystem(root)
        for listed in batches:
            for rel in listed["rel_path"].to_pylist():
                with pq.ParquetFile(f"{base}/{rel}", filesystem=system) as file:
                    there = set(file.schema_arrow.names)
                    own = [c for c in names if c in there]
                    # without any wanted column only the number of rows is of interest
                    for batch in file.iter_batches(batch_size=10_000, columns=own or file.schema_arrow.names[:1]):
                        n = batch.num_rows
                        arrays = [fitted(batch[c], wanted.field(c).type) if c in there else pa.nulls(n, wanted.field(c).type) for c in names]
                        yield pa.RecordBatch.from_arrays([*arrays, pa.array([rel] * n, pa.string())], names=[*names, "rel_path"])

    return in_tasks(files.select("rel_path", "size")).mapInArrow(read, out)


def read_documented(spark: SparkSession, root: str, schema: T.StructType | None = None, below: Sequence[str] = ("",)) -> DataFrame:
    """Files of the documented layout, or of ``asset_id=…/year=…`` folders, with their path parts as columns.

    All names are read, those that start with ``_`` or ``.`` too. Without ``schema`` the files' own columns.
    """
    files = snapshot(list_files(spark, root, below=below).where(F.col("rel_path").rlike(PLACE)), "documented")
    rows = read_files(files, root, schema or columns_of(files, root))
    table = F.coalesce(F.nullif(F.regexp_extract("rel_path", PLACE, 6), F.lit("")), F.regexp_extract("rel_path", PLACE, 7))
    parts = {"file_asset": value_of(F.regexp_extract("rel_path", PLACE, 1)), "file_table": value_of(table)} | {
        f"file_{name}": F.regexp_extract("rel_path", PLACE, i) for i, name in enumerate(("year", "month", "day", "hour"), start=2)}
    return rows.withColumns(parts).drop("rel_path")
