"""Copy and delete jobs: executors touch files, Spark moves only paths and result rows.

A job first writes its plan to the shared folder, runs from that snapshot, and writes its result
rows there too. So a lost executor repeats single files of a fixed plan, and reading the results
twice does not run the job twice. Both actions can be repeated without harm.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.constants import COPY_CHUNK_BYTES, COPY_RETRIES, COPY_RETRY_DELAY_S
from gaugelake.session import shared_dir
from gaugelake.sources.lake import filesystem

# A task's share: a lost executor repeats no more than that.
FILES_PER_TASK = 1000
BYTES_PER_TASK = 512 * 1024 * 1024

RESULT_SCHEMA = (
    "rel_path string, status string, reason string, size bigint, attempts int, finished_at timestamp"
)


def run_copy(
    plan: DataFrame,
    source_root: str,
    target_root: str,
    job_dir: str | None = None,
    tasks: int | None = None,
    retries: int = COPY_RETRIES,
    retry_delay_s: float = COPY_RETRY_DELAY_S,
) -> DataFrame:
    """Execute a sync plan; result rows have status ``uploaded``, ``skipped`` or ``failed``."""
    spark = plan.sparkSession
    job_dir = job_dir or _new_job_dir(spark, "copy")
    todo = _snapshot(plan.select("rel_path", "size", "action", "reason"), f"{job_dir}/plan")
    now = F.current_timestamp()
    skipped = todo.where("action = 'skip'").select(
        "rel_path", F.lit("skipped").alias("status"), "reason", "size",
        F.lit(0).alias("attempts"), now.alias("finished_at"),
    )

    def copy_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, source_base = filesystem(source_root)
        target, target_base = filesystem(target_root)
        for batch in batches:
            done = [
                _copy_one(source, f"{source_base}/{p}", target, f"{target_base}/{p}", retries, retry_delay_s)
                for p in batch["rel_path"]
            ]
            yield _result_rows(batch, done)

    uploads = todo.where("action = 'upload'").select("rel_path", "size")
    if uploads.isEmpty():
        return _snapshot(skipped, f"{job_dir}/results")
    copied = in_tasks(uploads, tasks).mapInPandas(copy_batches, RESULT_SCHEMA)
    return _snapshot(copied.unionByName(skipped), f"{job_dir}/results")


def run_delete(
    eligible: DataFrame, root: str, dry_run: bool = True, job_dir: str | None = None, tasks: int | None = None
) -> DataFrame:
    """Delete eligible files; by default only say which (``would_delete``)."""
    spark = eligible.sparkSession
    job_dir = job_dir or _new_job_dir(spark, "delete")
    todo = _snapshot(eligible.select("rel_path", "size"), f"{job_dir}/plan")
    if todo.isEmpty():
        return spark.createDataFrame([], RESULT_SCHEMA)
    if dry_run:
        return todo.select(
            "rel_path", F.lit("would_delete").alias("status"), F.lit(None).cast("string").alias("reason"),
            "size", F.lit(0).alias("attempts"), F.current_timestamp().alias("finished_at"),
        )

    def delete_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = filesystem(root)
        context = TaskContext.get()
        repeated = context is not None and context.attemptNumber() > 0
        for batch in batches:
            done = [_delete_one(files, f"{base}/{p}", repeated) for p in batch["rel_path"]]
            yield _result_rows(batch, done)

    deleted = in_tasks(todo, tasks).mapInPandas(delete_batches, RESULT_SCHEMA)
    return _snapshot(deleted, f"{job_dir}/results")


def in_tasks(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Files over ``tasks`` tasks, by default by bytes and number; how many run at a time is up to the cluster."""
    if tasks is None:
        n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        tasks = max(1, -(-n // FILES_PER_TASK), -(-size // BYTES_PER_TASK))
    return files.repartition(tasks)


def snapshot(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as it is now, in the shared folder."""
    return _snapshot(df, _new_job_dir(df.sparkSession, kind))


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def _new_job_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/filejobs/{kind}-{uuid.uuid4().hex}"


def _snapshot(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _copy_one(source, source_path: str, target, target_path: str, retries: int, delay_s: float):
    error = None
    for attempt in range(1, retries + 1):
        try:
            size = source.get_file_info(source_path).size
            target.create_dir(target_path.rsplit("/", 1)[0], recursive=True)
            # object stores publish a file when it is closed; elsewhere readers must not see a part
            staged = target.type_name in ("local", "hdfs")
            written = f"{target_path}.{uuid.uuid4().hex}.part" if staged else target_path
            try:
                with source.open_input_stream(source_path) as src, target.open_output_stream(written) as dst:
                    while chunk := src.read(COPY_CHUNK_BYTES):
                        dst.write(chunk)
                if target.get_file_info(written).size != size:
                    raise OSError("size differs after the copy")
                if staged:
                    target.move(written, target_path)
            except Exception:
                if staged:
                    _forget(target, written)
                raise
            return "uploaded", None, attempt
        except Exception as e:  # any failure of one file is a result row, not a failed job
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                time.sleep(delay_s * 2 ** (attempt - 1))
    return "failed", error, retries


def _forget(files, path: str) -> None:
    """Remove a part; a worker that is lost leaves it to the next sweep."""
    try:
        files.delete_file(path)
    except OSError:
        pass


def _delete_one(files, path: str, repeated: bool):
    from pyarrow import fs

    try:
        if files.get_file_info(path).type == fs.FileType.NotFound:
            # the plan saw the file: in a repeated task the earlier attempt removed it
            return ("deleted", "by_earlier_attempt", 1) if repeated else ("skipped", "file_not_found", 1)
        files.delete_file(path)
        return "deleted", None, 1
    except Exception as e:
        return "failed", f"{type(e).__name__}: {e}", 1


def _result_rows(batch: pd.DataFrame, done: list[tuple]) -> pd.DataFrame:
    status, reason, attempts = zip(*done) if done else ((), (), ())
    return pd.DataFrame({
        "rel_path": batch["rel_path"].to_numpy(),
        "status": list(status),
        "reason": list(reason),
        "size": batch["size"].to_numpy(),
        "attempts": list(attempts),
        "finished_at": pd.Timestamp(datetime.now(timezone.utc)),
    })
