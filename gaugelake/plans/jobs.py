"""The recurring work as batch jobs for an external scheduler.

    spark-submit -m gaugelake.plans.jobs ingest  --servers … --root …
    spark-submit -m gaugelake.plans.jobs refresh --root … --hour 2024-01-15T10
    spark-submit -m gaugelake.plans.jobs mirror  --root … --cold … --log …
    spark-submit -m gaugelake.plans.jobs expire  --root … --log … [--delete]
    spark-submit -m gaugelake.plans.jobs compact --root … --before 2024-01-15T10
    spark-submit -m gaugelake.plans.jobs status  --root … --log … --metrics …
    spark-submit -m gaugelake.plans.jobs stats   --root … --out …
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.constants import (
    BACKLOG_LIMIT, RAW_FLUSH_AGE, RETENTION_DAYS, ROLLUP_DELAY_S, STALE_AFTER_S, TOPIC_PATTERN, USAGE_LIMIT,
)
from gaugelake.functions import naming as N
from gaugelake.operators import alerts as A
from gaugelake.operators import filejobs as J
from gaugelake.operators import lifecycle as L
from gaugelake.operators import monitor as M
from gaugelake.plans import compact, ledger, tiers
from gaugelake.plans import pull as PL
from gaugelake.plans.refresh import LEVELS, TABLES, hour_folders, refresh_new, refresh_rollups, table, table_path
from gaugelake.session import configure
from gaugelake.sources import documented, lake
from gaugelake.sources.kafka import kafka_stream
from gaugelake.streaming.ingest import start_ingest

METRICS_SCHEMA = "ts timestamp, name string, labels map<string,string>, series string, value double, date string"
LOG_SCHEMA = "rel_path string, event string, logged_at timestamp"
#: Age of a part on the cold tier that no running copy writes any more.
PART_AGE = "1 DAY"


#: Component, metric, limit, and whether the metric is a time whose age counts.
HEALTH_LIMITS = [
    ("ingest", "last_message_time", float(STALE_AFTER_S), True),
    ("rollup", "rollup_delay_seconds", float(ROLLUP_DELAY_S), False),
    ("upload", "files_pending_upload", float(BACKLOG_LIMIT), False),
    ("storage", "storage_usage", USAGE_LIMIT, False),
]


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def mirror(spark: SparkSession, root: str, cold: str, log: str, now: datetime | None = None, **copy_options) -> DataFrame:
    """Bring the cold tier up to date, folder by folder: copy, verify, then retire; returns the result rows.

    What is new or changed is copied. Copies that a newer generation of their folder, or its compaction,
    has replaced are removed once all files of the new one are there and have the right size; a folder with
    a failed file keeps all its old copies. So a reader of the cold tier may see old and new files of a
    folder, never neither. Parts that a lost worker left behind are swept when they are ``PART_AGE`` old.
    """
    before = read_log(spark, log)
    remote = J.snapshot(lake.list_files(spark, cold, "*"), "remote")
    swept = _sweep_parts(remote, cold, now or _utc_now())
    remote = lake.data_files(remote.where(F.endswith("rel_path", F.lit(".parquet"))))
    local = lake.data_files(lake.list_files(spark, root))
    compacted = tiers.has_replaced(spark, root)
    if compacted:
        replaced = ledger.read(spark, root, "replaced")
        raw, below = F.startswith("rel_path", F.lit("raw/")), F.regexp_replace(tiers.folder_of(F.col("rel_path")), "^raw/", "")
        local = local.where(~raw).unionByName(tiers.without_replaced(local.where(raw).withColumn("folder", below), replaced).drop("folder"))
    plan = J.snapshot(L.sync_plan(local, remote), "sync-plan")
    results = J.run_copy(plan, root, cold, **copy_options)
    failed = results.where("status = 'failed'").select("rel_path")
    stale = L.retired(plan, remote, failed, tiers.folder_of(F.col("rel_path")), tiers.generation(F.col("rel_path")))
    if compacted:
        stale = stale.unionByName(_compacted_copies(remote.where(raw).withColumn("folder", below), replaced, failed, plan).select(*remote.columns))
    removed = J.run_delete(stale, cold, dry_run=False)
    entries = L.log_entries(L.news(results, before)).unionByName(
        removed.where("status = 'deleted'").select("rel_path", F.lit("superseded").alias("event"), F.col("finished_at").alias("logged_at")))
    J.append_log(entries, log)
    return results.unionByName(removed.withColumn("reason", F.lit("superseded"))).unionByName(swept)


def _compacted_copies(remote: DataFrame, replaced: DataFrame, failed: DataFrame, plan: DataFrame) -> DataFrame:
    """Copies in folders whose compaction is on the cold tier without a failure."""
    batch = tiers.batch_of(F.col("rel_path"))
    there = plan.select(batch.alias("by")).unionByName(remote.select(batch.alias("by"))).distinct()
    there = there.join(failed.select(batch.alias("by")).distinct(), "by", "left_anti")
    return remote.join(replaced.distinct().join(there, "by", "left_semi").select("folder").distinct(), "folder", "left_semi").drop("folder")


def _sweep_parts(remote: DataFrame, cold: str, now: datetime) -> DataFrame:
    old = remote.where(F.endswith("rel_path", F.lit(".part")) & (F.col("mtime") < L.instant(now, "timestamp") - F.expr(f"INTERVAL {PART_AGE}")))
    return J.run_delete(old, cold, dry_run=False).withColumn("reason", F.lit("left_over"))


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The upload log; one that is not there yet is empty."""
    return spark.read.schema(LOG_SCHEMA).parquet(log) if lake.exists(spark, log) else spark.createDataFrame([], LOG_SCHEMA)


def expire(
    spark: SparkSession, root: str, log: str, now: datetime, age_days: int = RETENTION_DAYS, dry_run: bool = True,
    tables: Sequence[str] | None = None, **delete_options,
) -> DataFrame:
    """Delete old, mirrored files (only listed unless ``dry_run=False``); returns the result rows.

    ``tables`` are the folders below the root to look at, by default all but the engine's own tables. The
    log says ``deleting`` before the first file goes and ``deleted`` after the last: a run that breaks off
    in between leaves no file that is gone without a word.
    """
    if tables is None:
        files = lake.list_files(spark, root)
    else:
        files = lake.list_files(spark, root, below=tables)
    files = lake.data_files(files)
    eligible = J.snapshot(L.cleanup_eligible(files, read_log(spark, log), now, age_days), "eligible")
    if not dry_run:
        J.append_log(eligible.select("rel_path", F.lit("deleting").alias("event"), F.current_timestamp().alias("logged_at")), log)
    results = J.run_delete(eligible, root, dry_run, **delete_options)
    if not dry_run:
        J.append_log(L.log_entries(results), log)
    return results


def export(spark: SparkSession, root: str, out: str, hours: Sequence[datetime], cold: str | None = None, log: str | None = None) -> DataFrame:
    """Raw rows and rollups of these hours, and rollups of their days, as files of the documented layout below ``out``.

    They come from both tiers and replace files of earlier exports. Returns path, rows and size of each file.
    """
    gone = L.gone(read_log(spark, log)) if log else None
    days = sorted({h.strftime("event_date=%Y-%m-%d") for h in hours})
    raw = tiers.rows(spark, root, cold, "raw", TABLES["raw"], hour_folders(hours), gone)
    written = [documented.write_raw_files(raw.drop(*lake.TIME_PARTITIONS, "ingest_batch"), out)]
    for level, folders in (("minute", hour_folders(hours)), ("hour", days), ("day", days)):
        rollup = tiers.rows(spark, root, cold, level, TABLES[level], folders, gone)
        written.append(documented.write_rollup_files(rollup.drop(*lake.TIME_PARTITIONS), out, level))
    return reduce(DataFrame.unionByName, written)


def stats(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes per tier and asset of the engine's tables, per tier and in total (``*`` stands for all).

    A file of several assets counts for each of them, with its size by their rows; in totals it counts once.
    """
    tables = [lake.asset_files(table(spark, root, name), name) for name in TABLES if lake.exists(spark, table_path(root, name))]
    if not tables:
        return L.storage_stats(lake.manifest_parts(lake.data_files(lake.list_files(spark, root))))
    per_file = J.snapshot(reduce(DataFrame.unionByName, tables), "asset-files")
    sizes = [F.countDistinct("file").alias("files"), F.round(F.sum("size")).cast("bigint").alias("size_bytes")]
    everything = F.lit("*")
    per_asset = per_file.groupBy("tier", "asset_id").agg(*sizes)
    per_tier = per_file.groupBy("tier").agg(*sizes).select("tier", everything.alias("asset_id"), "files", "size_bytes")
    total = per_tier.groupBy().agg(F.sum("files").alias("files"), F.sum("size_bytes").alias("size_bytes")).select(
        everything.alias("tier"), everything.alias("asset_id"), "files", "size_bytes")
    return per_asset.unionByName(per_tier).unionByName(total).withColumn("size_mb", N.megabytes(F.col("size_bytes")))


def status(spark: SparkSession, root: str, log: str, metrics: str, now: datetime, capacity_bytes: int | None = None) -> DataFrame:
    """Write what is known about the lake to the metrics table, one sample of each gauge; returns the samples.

    ``files_pending_upload``, ``bytes_pending_upload``; ``storage_used_bytes``, ``storage_files`` and, with a capacity,
    ``storage_usage``; ``landed_rows``, ``landed_files``; ``rollup_delay_seconds`` since the end of the newest
    hour that is rolled up (none before the first).
    """
    files = J.snapshot(lake.data_files(lake.list_files(spark, root)), "status")
    pending = L.backlog_report(L.backlog(files, read_log(spark, log))).select(
        F.col("pending_files").alias("files_pending_upload"), F.col("pending_bytes").alias("bytes_pending_upload"))
    used = F.coalesce(F.sum("size"), F.lit(0))
    usage = [(used / F.lit(float(capacity_bytes))).alias("storage_usage")] if capacity_bytes else []
    stored = files.agg(used.alias("storage_used_bytes"), F.count("*").alias("storage_files"), *usage)
    landed = ledger.landed(spark, root).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"landed_{c}") for c in ("rows", "files")])
    newest = F.max(F.to_timestamp(F.concat_ws(" ", "event_date", "event_hour"), "yyyy-MM-dd HH")) + F.expr("INTERVAL 1 HOUR")
    delay = ledger.read(spark, root, "refreshed").agg(
        (F.unix_seconds(L.instant(now, "timestamp")) - F.unix_seconds(newest)).alias("rollup_delay_seconds"))
    samples = [M.as_metrics(report, now) for report in (pending, stored, landed, delay)]
    out = J.snapshot(reduce(DataFrame.unionByName, samples).where("value IS NOT NULL"), "status-samples")
    M.write_metrics(out, metrics)
    return out


def health(metrics: DataFrame, now: datetime) -> DataFrame:
    """``component``, ``healthy``, ``issues`` from the last samples of all series, and ``overall``: whether all known ones are.

    Of a component without samples nothing is known (NULL), and it does not count.
    """
    spark = metrics.sparkSession
    limits = spark.createDataFrame(HEALTH_LIMITS, "component string, name string, `limit` double, of_time boolean")
    measure = F.when(F.col("of_time"), F.unix_seconds(L.instant(now, "timestamp")) - F.col("last_value")).otherwise(F.col("last_value"))
    # grouped by name and series first, so at most a row for each series meets the few limits
    seen = limits.join(M.last_values(metrics), "name", "left").withColumn("over", measure > F.col("limit"))
    judged = seen.groupBy("component").agg(
        (~F.bool_or("over")).alias("healthy"),
        F.array_sort(F.collect_set(F.when(F.col("over"), F.concat_ws(" of ", "name", F.nullif("series", F.lit("")))))).alias("issues"))
    overall = judged.agg(F.lit("overall").alias("component"), F.coalesce(F.bool_and("healthy"), F.lit(True)).alias("healthy"),
                         F.array_sort(F.flatten(F.collect_list("issues"))).alias("issues"))
    return judged.unionByName(overall)


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gaugelake")
    jobs = parser.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("ingest", help="land a topic pattern in the raw table")
    job.add_argument("--servers", required=True)
    job.add_argument("--root", required=True)
    job.add_argument("--topics", default=TOPIC_PATTERN)
    job.add_argument("--starting-offsets", default="latest")
    job.add_argument("--max-offsets-per-trigger", type=int)
    job.add_argument("--every", default=RAW_FLUSH_AGE)
    job.add_argument("--drain", action="store_true", help="take what there is and end")
    job.add_argument("--checkpoint", required=True)

    job = jobs.add_parser("refresh", help="recompute rollups of hours and their days")
    job.add_argument("--root", required=True)
    which = job.add_mutually_exclusive_group(required=True)
    which.add_argument("--hour", action="append", type=datetime.fromisoformat)
    which.add_argument("--new", action="store_true", help="the hours of all rows that landed since the last such refresh")
    job.add_argument("--cold", help="cold tier, for hours whose raw files have expired")
    job.add_argument("--log", help="upload log, to tell such hours")
    job.add_argument("--level", choices=LEVELS, default="both")

    job = jobs.add_parser("mirror", help="copy new and changed files to the cold tier")
    job.add_argument("--root", required=True)
    job.add_argument("--cold", required=True)
    job.add_argument("--log", required=True)

    job = jobs.add_parser("expire", help="list or delete old files that are mirrored")
    job.add_argument("--root", required=True)
    job.add_argument("--log", required=True)
    job.add_argument("--age-days", type=int, default=RETENTION_DAYS)
    job.add_argument("--table", action="append", help="only this table; may be given more than once")
    job.add_argument("--delete", action="store_true")

    job = jobs.add_parser("compact", help="merge small raw files of hours that are over")
    job.add_argument("--root", required=True)
    job.add_argument("--before", type=datetime.fromisoformat, required=True)

    job = jobs.add_parser("pull", help="take what is new in a database table")
    job.add_argument("--url", required=True)
    job.add_argument("--table", required=True)
    job.add_argument("--ts-col", default="timestamp")
    job.add_argument("--to", required=True)
    job.add_argument("--state", required=True)

    job = jobs.add_parser("status", help="backlog, storage, landing and rollup delay as metrics")
    job.add_argument("--root", required=True)
    job.add_argument("--log", required=True)
    job.add_argument("--metrics", required=True)
    job.add_argument("--capacity-bytes", type=int)

    for name, what in (("health", "whether the components are healthy"), ("alerts", "rules that have fired")):
        job = jobs.add_parser(name, help=what)
        job.add_argument("--metrics", required=True)

    job = jobs.add_parser("export", help="files under the documented names")
    job.add_argument("--root", required=True)
    job.add_argument("--to", required=True)
    job.add_argument("--hour", action="append", type=datetime.fromisoformat, required=True)
    job.add_argument("--cold")
    job.add_argument("--log")

    job = jobs.add_parser("stats", help="files and bytes per tier and asset")
    job.add_argument("--root", required=True)
    job.add_argument("--out", required=True, help="where the table of results goes")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _arguments().parse_args(argv)
    spark = configure(SparkSession.builder.appName(f"gaugelake {args.job}").getOrCreate())
    if args.job == "ingest":
        messages = kafka_stream(
            spark, args.servers, topic_pattern=args.topics, starting_offsets=args.starting_offsets,
            max_offsets_per_trigger=args.max_offsets_per_trigger,
        )
        start_ingest(
            messages, args.root, checkpoint=args.checkpoint, drain=args.drain, every=args.every
        ).awaitTermination()
    elif args.job == "refresh":
        deleted = L.gone(read_log(spark, args.log)) if args.log else None
        if args.new:
            refresh_new(spark, args.root, args.level, cold=args.cold, deleted=deleted)
        else:
            refresh_rollups(spark, args.root, args.hour, args.level, cold=args.cold, deleted=deleted)
    elif args.job == "mirror":
        L.sync_summary(mirror(spark, args.root, args.cold, args.log)).show(truncate=False)
    elif args.job == "expire":
        results = expire(spark, args.root, args.log, _utc_now(), args.age_days, dry_run=not args.delete, tables=args.table)
        L.cleanup_report(results).show(truncate=False)
    elif args.job == "compact":
        compact.compact(spark, args.root, args.before)
    elif args.job == "pull":
        PL.pull(spark, PL.JdbcTable(args.url, args.table, args.ts_col), args.to, args.state)
    elif args.job == "status":
        status(spark, args.root, args.log, args.metrics, _utc_now(), args.capacity_bytes)
    elif args.job == "health":
        health(spark.read.schema(METRICS_SCHEMA).parquet(args.metrics), _utc_now()).show(truncate=False)
    elif args.job == "alerts":
        A.fired(spark.read.schema(METRICS_SCHEMA).parquet(args.metrics)).show(truncate=False)
    elif args.job == "export":
        export(spark, args.root, args.to, args.hour, args.cold, args.log).show(truncate=False)
    elif args.job == "stats":
        stats(spark, args.root).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
