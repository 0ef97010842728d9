"""The hot and the cold tier as one table.

A folder of a table is written by one job, whose mark Spark puts into the names of its files: their
generation. Retention may take some or all of these files from the hot tier; the cold tier has them. A job
that writes a folder again makes a new generation, and the mirror removes the old one from the cold tier,
but later. So of a folder count

- all files in the hot tier, and of the cold tier those of the same generation that are not in the hot one;
- if the hot tier has none, the newest generation of the cold tier.

Folders of ``raw/`` that compaction has replaced do not count, nor do replacements that are not complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake.operators.filejobs import snapshot
from gaugelake.plans import ledger
from gaugelake.sources import lake

_JOB_MARK = r"(?:^|/)part-\d+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[^/]*$"
#: Batches of the raw table that compaction has written.
COMPACTED = "compacted-"


def generation(path: Column) -> Column:
    """The mark of the job that wrote a file; empty for names that have none."""
    return F.regexp_extract(path, _JOB_MARK, 1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def batch_of(folder: Column) -> Column:
    return F.regexp_extract(folder, r"ingest_batch=([^/]*)", 1)


def without_replaced(files: DataFrame, replaced: DataFrame) -> DataFrame:
    """``files`` (with ``folder``, below the raw table) less replaced folders and unfinished replacements."""
    by = replaced.select(F.col("by").alias("batch")).distinct()
    batch = F.when(batch_of(F.col("folder")).startswith(COMPACTED), batch_of(F.col("folder")))
    known = files.withColumn("batch", batch).join(by.withColumn("finished", F.lit(True)), "batch", "left").where("batch IS NULL OR finished")
    return known.drop("batch", "finished").join(replaced.select("folder").distinct(), "folder", "left_anti")


def has_replaced(spark: SparkSession, root: str) -> bool:
    """Whether compaction has begun anything in this lake."""
    return lake.exists(spark, ledger.place(root, "replaced"))


def raw_table(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The whole raw table of the hot tier, each row once also while it is compacted."""
    path = f"{root.rstrip('/')}/raw"
    if not lake.exists(spark, path):
        return spark.createDataFrame([], schema)
    table = spark.read.schema(schema).parquet(path)
    if not has_replaced(spark, root):
        return table
    replaced = ledger.read(spark, root, "replaced")
    old = replaced.select(*[F.try_url_decode(F.regexp_extract("folder", f"{k}=([^/]*)", 1)).alias(k) for k in ledger.KEYS]).distinct()
    by = replaced.select(F.col("by").alias("ingest_batch")).distinct()
    plain = table.where(~F.startswith("ingest_batch", F.lit(COMPACTED)))
    finished = table.where(F.startswith("ingest_batch", F.lit(COMPACTED))).join(by, "ingest_batch", "left_semi").select(*table.columns)
    return plain.unionByName(finished).join(old, list(ledger.KEYS), "left_anti").select(*table.columns)


def both_tiers(spark: SparkSession, root: str, cold: str | None, name: str, folders: Sequence[str]) -> DataFrame:
    """Every file of these folders of a table, once: ``rel_path``, ``folder``, ``generation``, ``hot``, ``size``, ``mtime``, ``live``."""
    def listed(tier: str, hot: bool) -> DataFrame:
        return lake.list_files(spark, f"{tier.rstrip('/')}/{name}", below=folders).withColumn("hot", F.lit(hot))

    found = listed(root, True)
    if cold is not None:
        found = found.unionByName(listed(cold, False))
    files = found.groupBy("rel_path").agg(F.bool_or("hot").alias("hot"), F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    files = files.select("*", folder_of(F.col("rel_path")).alias("folder"), generation(F.col("rel_path")).alias("generation"))
    if name == "raw" and has_replaced(spark, root):
        files = without_replaced(files, ledger.read(spark, root, "replaced"))
    here = W.partitionBy("folder")
    own = F.collect_set(F.when(F.col("hot"), F.col("generation"))).over(here)
    newest = F.max_by("generation", F.struct("mtime", "generation")).over(here)
    live = F.when(F.size("hot_ones") > 0, F.array_contains("hot_ones", F.col("generation"))).otherwise(F.col("generation") == F.col("newest"))
    return files.withColumns({"hot_ones": own, "newest": newest}).withColumn("live", live).drop("hot_ones", "newest")


def lost(files: DataFrame, name: str, folders: Sequence[str], deleted: DataFrame, replaced: DataFrame | None) -> DataFrame:
    """Deleted files (``rel_path`` below the root) of these folders that count but that no tier has."""
    depth = folders[0].count("/") + 1
    wanted = files.sparkSession.createDataFrame([(f,) for f in folders], "part string")
    gone = deleted.where(F.startswith("rel_path", F.lit(f"{name}/"))).select(F.substring("rel_path", len(name) + 2, 2**31 - 1).alias("rel_path")).distinct()
    gone = gone.withColumn("part", F.substring_index("rel_path", "/", depth)).join(wanted, "part", "left_semi").drop("part")
    missing = gone.join(files, "rel_path", "left_anti").select(
        "rel_path", folder_of(F.col("rel_path")).alias("folder"), generation(F.col("rel_path")).alias("generation"))
    alive = files.where("live").groupBy("folder").agg(F.collect_set("generation").alias("alive"))
    found = missing.join(alive, "folder", "left").where(F.col("alive").isNull() | F.array_contains("alive", F.col("generation")))
    return (without_replaced(found, replaced) if replaced is not None else found).select("rel_path")


def rows(spark: SparkSession, root: str, cold: str | None, name: str, schema: T.StructType, folders: Sequence[str],
         deleted: DataFrame | None = None) -> DataFrame:
    """All rows that ever landed in these folders of a table, whichever tier has them; absent folders are empty.

    ``deleted`` are the ``rel_path``s of files that retention has taken. Folders that have lost some to no
    known tier are refused: what is made of them would replace complete results by incomplete ones.
    """
    path = f"{root.rstrip('/')}/{name}"
    if not folders:
        return spark.createDataFrame([], schema)
    if cold is None and deleted is None and not (name == "raw" and has_replaced(spark, root)):
        return lake.read_folders(spark, path, schema, folders)
    files = snapshot(both_tiers(spark, root, cold, name, folders), "tiers")
    if deleted is not None:
        unfound = lost(files, name, folders, deleted, ledger.read(spark, root, "replaced") if name == "raw" and has_replaced(spark, root) else None)
        gone = sorted(r["folder"] for r in unfound.select(folder_of(F.col("rel_path")).alias("folder")).distinct().collect())
        if gone:
            raise ValueError(f"files of these folders of {name} have expired and are on no tier that was named: {gone}")
    out = spark.createDataFrame([], schema)
    # as many paths as Spark's own index of these folders holds
    live = files.where("live").select("rel_path", "hot").collect()
    for tier, hot in ((root, True), (cold, False)):
        own = [f"{tier.rstrip('/')}/{name}/{r['rel_path']}" for r in live if r["hot"] == hot] if tier else []
        if own:
            out = out.unionByName(spark.read.schema(schema).option("basePath", f"{tier.rstrip('/')}/{name}").parquet(*own))
    return out
