"""Sharding (operator 2): vector bin packing of groups over bytes, tokens and rows.

Rows with equal texts are a group. Groups heavy enough to matter by themselves are units of the plan, cut
into even parts where one is too heavy for a shard; all others fall into cells by hash of their text,
and the cells are units. The number of units has a fixed bound, so the driver can place them, heaviest
first, each where the dot product of its vector and what a shard has left is highest. A last pass moves
light units from the shard with most bytes to the one with least while that evens them out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake.llm.shared import stored

#: Cells for groups that are not units by themselves, for each shard.
CELLS = 512
#: A group is a unit by itself from this part of a shard on, by any measure.
HEAVY = 1 / 256
#: Parts in which the rows of a shard are numbered.
SALTS = 64

SIZES = ("size", "tokens", "rows")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("bigint")


def place(units: Sequence[Sequence[float]], shards: int) -> list[int]:
    """The shard of each unit (a vector of sizes)."""
    if not units:
        return []
    sizes = np.array(units, float)
    scaled = sizes / np.maximum(sizes.sum(0), 1) * shards  # a shard holds 1 of each
    left = np.ones((shards, sizes.shape[1]))
    where = np.zeros(len(sizes), int)
    for i in np.lexsort((np.arange(len(sizes)), -scaled.max(1))):
        room = left - scaled[i]
        over = np.minimum(room, 0).sum(1)  # what would not fit counts first
        score = left @ scaled[i]
        best = max(range(shards), key=lambda s: (round(over[s], 12), score[s], -s))
        where[i] = best
        left[best] -= scaled[i]
    return _evened(scaled[:, 0], where, shards).tolist()


def _evened(size: np.ndarray, where: np.ndarray, shards: int) -> np.ndarray:
    """Moves while one from the fullest to the emptiest shard narrows the gap between them."""
    load = np.bincount(where, size, shards)
    for _ in range(4 * len(size)):
        full, empty = int(load.argmax()), int(load.argmin())
        own = np.flatnonzero((where == full) & (size > 0))
        gap = load[full] - load[empty]
        own = own[size[own] < gap * (1 - 1e-9)]
        if not len(own):
            break
        unit = own[np.abs(size[own] - gap / 2).argmin()]
        where[unit] = empty
        load[full] -= size[unit]
        load[empty] += size[unit]
    return where


def sharded(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
            tokens: Column | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``tokens``, ``text_crc32``, ``shard`` and ``slot`` of each row of ``df``.

    ``size`` is the text's UTF-8 bytes and one more; a NULL text is empty. Slots count from 0 in each
    shard. Repeated rows are rows of one group; NULL ids are allowed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        (tokens if tokens is not None else token_count(text)).alias("tokens"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("group"))
    rows = stored(rows, "sharding-rows")  # some 80 bytes a row; texts are read once
    groups = rows.groupBy("group").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SIZES]).first()

    limit = [max(1.0, total[c] / shards * HEAVY) for c in SIZES]
    heavy = F.lit(False)
    for c, most in zip(SIZES, limit, strict=True):
        heavy = heavy | (F.col(c) >= most)
    parts = F.ceil(F.greatest(*[F.col(c) / (4 * most) for c, most in zip(SIZES, limit, strict=True)])).cast("int")
    groups = groups.withColumn("parts", F.when(heavy, F.least(parts, F.col("rows").cast("int"))))
    alone = groups.filter("parts IS NOT NULL").select("group", "parts")  # 3 * shards / HEAVY rows at most
    cell = F.pmod(F.xxhash64("group"), F.lit(CELLS * shards)).cast("int")

    marked = rows.join(F.broadcast(alone), "group", "left").withColumn(
        "key", F.when(F.col("parts").isNull(), F.lit(None).cast("binary")).otherwise(F.col("group"))).withColumn(
        "part", F.when(F.col("parts").isNull(), cell).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")))
    units = marked.groupBy("key", "part").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("key", "part").collect()
    shard_of = place([[u[c] for c in SIZES] for u in units], shards)
    plan = df.sparkSession.createDataFrame(
        [(u["key"], u["part"], s) for u, s in zip(units, shard_of, strict=True)], "key binary, part int, shard int")

    placed = marked.join(F.broadcast(plan), marked["key"].eqNullSafe(plan["key"]) & (marked["part"] == plan["part"])).select(
        "doc_id", "size", "tokens", "text_crc32", "group", "shard",
        F.pmod(F.xxhash64("group", "doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    counted = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = counted.select("shard", "salt", (F.sum("n").over(W.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("shard", "salt").orderBy("doc_id", "group"))
    return placed.withColumn("own", own).join(F.broadcast(before), ["shard", "salt"]).select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("before") + F.col("own") - 1).cast("bigint").alias("slot"))
