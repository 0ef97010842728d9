"""Mirroring to the cold tier and retention, as plans over file manifests.

A manifest has ``rel_path, size, mtime`` (and ``path`` where files are touched). The upload log has
``rel_path, event, logged_at`` and may repeat entries. Events are ``uploaded``, ``deleting`` (written before the
first file goes), ``deleted`` and ``superseded`` (a copy that a newer one has replaced).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.constants import BACKLOG_LIMIT, RETENTION_DAYS, SIZE_TOLERANCE_BYTES
from gaugelake.functions import naming as N
from gaugelake.functions.timing import instant


def sync_plan(local: DataFrame, remote: DataFrame, tolerance: int = SIZE_TOLERANCE_BYTES) -> DataFrame:
    """Which local files to upload and why.

    A file goes up when it is missing remotely, newer than its copy, or differs in size by more
    than the tolerance. Both manifests are unique by path, so the join cannot multiply rows;
    whether it broadcasts is left to the size statistics.
    """
    other = remote.select(
        "rel_path",
        F.col("size").alias("remote_size"),
        F.col("mtime").alias("remote_mtime"),
    )
    reason = (
        F.when(F.col("remote_size").isNull(), "missing_remote")
        .when(F.col("mtime") > F.col("remote_mtime"), "local_newer")
        .when(F.abs(F.col("size") - F.col("remote_size")) > tolerance, "size_differs")
        .otherwise("already_up_to_date")
    )
    plan = local.join(other, "rel_path", "left").withColumn("reason", reason)
    action = F.when(F.col("reason") == "already_up_to_date", "skip").otherwise("upload")
    return plan.select(*local.columns, action.alias("action"), "reason")


def retired(local: DataFrame, remote: DataFrame, failed: DataFrame, folder: Column, generation: Column) -> DataFrame:
    """Copies that a newer generation of their folder has replaced.

    A copy goes if the hot tier has files in its folder, none of them of its generation, and all of the
    folder's files are on the cold tier (none has ``failed``). Copies of expired files stay: nothing is in
    their folder, or the rest of their generation. Names without a generation stay as well.
    """
    own = local.select(folder.alias("folder"), generation.alias("generation")).where("generation <> ''").groupBy("folder").agg(
        F.collect_set("generation").alias("own"))
    whole = own.join(failed.select(folder.alias("folder")).distinct(), "folder", "left_anti")
    copies = remote.withColumns({"folder": folder, "generation": generation})
    return copies.join(whole, "folder").where(
        (F.col("generation") != "") & ~F.array_contains("own", F.col("generation"))).select(*remote.columns)


def gone(log: DataFrame) -> DataFrame:
    """Paths of files that retention has deleted or was about to delete."""
    return log.where(F.col("event").isin("deleting", "deleted")).select("rel_path").distinct()


def sync_summary(results: DataFrame) -> DataFrame:
    """Totals per status of copy results."""
    return results.groupBy("status").agg(
        F.count("*").alias("files"),
        F.sum("size").alias("size_bytes"),
        N.megabytes(F.sum("size")).alias("size_mb"),
        F.max("finished_at").alias("last_time"),
    )


def planned_results(plan: DataFrame, finished_at: Column) -> DataFrame:
    """The plan as the result rows a faultless run would give."""
    return plan.select(
        "rel_path", "size",
        F.when(F.col("action") == "upload", "uploaded").otherwise("skipped").alias("status"),
        "reason", finished_at.alias("finished_at"),
    )


def log_entries(results: DataFrame) -> DataFrame:
    """Copy or delete results -> upload-log entries.

    A file skipped because its copy is up to date is mirrored too, so it counts as uploaded.
    """
    mirrored = (F.col("status") == "uploaded") | (
        (F.col("status") == "skipped") & (F.col("reason") == "already_up_to_date")
    )
    event = F.when(mirrored, "uploaded").when(F.col("status") == "deleted", "deleted")
    return results.select(
        "rel_path", event.alias("event"), F.col("finished_at").alias("logged_at")
    ).where(F.col("event").isNotNull())


def news(results: DataFrame, log: DataFrame) -> DataFrame:
    """Copy results that change what the log says: copies, and files found up to date for the first time."""
    known = uploaded_set(log).select("rel_path")
    again = F.col("reason").eqNullSafe("already_up_to_date")
    return results.where(~again).unionByName(results.where(again).join(known, "rel_path", "left_anti"))


def uploaded_set(log: DataFrame) -> DataFrame:
    """Paths whose latest entry is an upload, once each.

    Two plain maxima decide, so repeated entries shrink before the shuffle.
    """
    def latest(event: str) -> Column:
        return F.max(F.when(F.col("event") == event, F.col("logged_at")))

    state = log.groupBy("rel_path").agg(
        latest("uploaded").alias("uploaded_at"), latest("deleted").alias("deleted_at")
    )
    live = F.col("uploaded_at").isNotNull() & (
        F.col("deleted_at").isNull() | (F.col("uploaded_at") > F.col("deleted_at"))
    )
    return state.where(live).select("rel_path", "uploaded_at")


def expired(manifest: DataFrame, now: datetime, age_days: int = RETENTION_DAYS) -> DataFrame:
    """Files last modified before ``now - age_days``."""
    cutoff = instant(now, manifest.schema["mtime"].dataType.simpleString()) - F.expr(f"INTERVAL {int(age_days)} DAYS")
    return manifest.where(F.col("mtime") < cutoff)


def cleanup_eligible(
    manifest: DataFrame, log: DataFrame, now: datetime, age_days: int = RETENTION_DAYS, enabled: bool = True
) -> DataFrame:
    """Old files whose copy is on the cold tier."""
    if not enabled:
        return manifest.limit(0)
    return expired(manifest, now, age_days).join(uploaded_set(log), "rel_path", "left_semi")


def backlog(manifest: DataFrame, log: DataFrame) -> DataFrame:
    """Files not on the cold tier yet."""
    return manifest.join(uploaded_set(log), "rel_path", "left_anti")


def backlog_report(pending: DataFrame, limit: int = BACKLOG_LIMIT, by: tuple[str, ...] = ()) -> DataFrame:
    counted = pending.groupBy(*by).agg(
        F.count("*").alias("pending_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("pending_bytes")
    )
    return counted.withColumn("breach", F.col("pending_files") > limit)


def dry_run(eligible: DataFrame) -> DataFrame:
    return eligible.select(
        "rel_path", F.lit("would_delete").alias("status"), N.megabytes(F.col("size")).alias("size_mb")
    )


def cleanup_report(results: DataFrame) -> DataFrame:
    """One row of totals over delete results (``status``, ``size``)."""
    deleted = F.col("status") == "deleted"
    return results.agg(
        F.count("*").alias("files_processed"),
        F.count_if(deleted).alias("files_deleted"),
        F.count_if(F.col("status") == "would_delete").alias("files_would_delete"),
        F.count_if(F.col("status") == "failed").alias("files_failed"),
        F.count_if(F.col("status") == "skipped").alias("files_skipped"),
        F.coalesce(F.sum(F.when(deleted, F.col("size"))), F.lit(0)).alias("bytes_freed"),
    )


def storage_stats(manifest: DataFrame) -> DataFrame:
    """Files and bytes per (tier, asset), per tier, and in total (``*`` stands for all).

    The totals are rolled up from the per-asset rows, so files are counted once.
    """
    per_asset = manifest.groupBy("tier", "asset_id").agg(
        F.count("*").alias("files"), F.sum("size").alias("size_bytes")
    )
    rolled = per_asset.rollup("tier", "asset_id").agg(
        F.sum("files").alias("files"), F.sum("size_bytes").alias("size_bytes")
    )
    return rolled.select(
        F.coalesce("tier", F.lit("*")).alias("tier"),
        F.coalesce("asset_id", F.lit("*")).alias("asset_id"),
        "files", "size_bytes", N.megabytes(F.col("size_bytes")).alias("size_mb"),
    )


def listing(remote: DataFrame, content_type: str = "application/octet-stream") -> DataFrame:
    """Remote manifest as a listing: name, size_mb, last_modified, content_type."""
    return remote.select(
        F.col("rel_path").alias("name"),
        N.megabytes(F.col("size")).alias("size_mb"),
        F.col("mtime").alias("last_modified"),
        F.lit(content_type).alias("content_type"),
    )


def listing_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("count"), F.sum("size_mb").alias("total_size_mb"))
