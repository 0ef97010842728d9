"""Best-fit packing (operator 1): planned over counts of lengths, filled by rank within length.

The driver sees one count for each length (at most ``capacity`` rows). It places all pieces of a length
at once: runs of sequences with equal room take as many as fit, fullest runs first, longest lengths
first. The plan is a list of runs of slots; pieces meet their slots in a join on (length, rank).
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake.llm.shared import stored, texts
from gaugelake.llm.wordbpe import encoder, grouped

CAPACITY = 2048
#: Ranks within a length are counted in so many parts, so that a frequent length is not one task.
SALTS = 64
#: Slots made from one row of the plan.
SLOTS_PER_ROW = 10_000


class Run(NamedTuple):
    """Ranks ``rank`` to ``rank + count - 1`` of a length: ``each`` to a sequence, from ``sequence`` on."""

    length: int
    rank: int
    count: int
    each: int
    sequence: int
    offset: int


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over ``counts`` (length -> pieces)."""
    plan: list[Run] = []
    rooms: list[int] = []  # sorted rooms that some run of sequences has
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number)
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in runs:
                bisect.insort(rooms, room)
            runs.setdefault(room, []).append((first, n))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = room // length
            full, rest = divmod(min(left, n * each), each)
            if full:
                plan.append(Run(length, rank, full * each, each, first, capacity - room))
                put(room - each * length, first, full)
            if rest:
                plan.append(Run(length, rank + full * each, rest, rest, first + full, capacity - room))
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            taken = full * each + rest
            left, rank = left - taken, rank + taken
    return plan


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, separator: int = 0, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``) of each text's pieces.

    A text is its ids and ``separator``; one longer than ``capacity`` is cut into pieces of it. A NULL
    or empty text is the separator alone. Repeated rows give their pieces each; a NULL id stays NULL.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    end = np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, 1_000_000)  # nothing else takes memory here
        for batch in batches:
            ids_of, texts_of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in grouped(texts_of):
                rows = []
                for doc_id, ids in zip(ids_of[low:high], words.encode_all(texts_of[low:high]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[:len(names)])
                yield _batch(rows, names, kinds)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return texts(df, id_col, text_col).mapInArrow(cut, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def packed(df: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32"),
           length_col: str = "length") -> DataFrame:
    """``df`` with ``sequence_id`` and ``offset``: no sequence holds more than ``capacity``, offsets have no gaps.

    ``length_col`` is from 1 to ``capacity``; ``order`` fixes which of equally long rows comes first (of
    rows equal in it, any). ``df`` is read several times and must give the same rows each time.
    """
    salted = df.withColumn("__length", F.col(length_col).cast("bigint")).withColumn(
        "__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    counted = salted.groupBy("__length", "__salt").agg(F.count("*").alias("__n"))
    counted = stored(counted, "packing-counts")  # at most capacity * SALTS rows
    counts = {int(r[0]): int(r[1]) for r in counted.groupBy("__length").agg(F.sum("__n")).collect()}
    spark = df.sparkSession
    plan = spark.createDataFrame(best_fit(counts, capacity) or [], "length bigint, rank bigint, count bigint, each bigint, sequence bigint, offset bigint")

    rows = plan.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1, F.lit(SLOTS_PER_ROW))).alias("from"))
    rows = rows.repartition("length", "rank", "from")
    slots = rows.select("*", F.explode(F.sequence("from", F.least(F.col("from") + SLOTS_PER_ROW, F.col("count")) - 1)).alias("k")).select(
        F.col("length").alias("__length"), (F.col("rank") + F.col("k")).alias("__rank"),
        (F.col("sequence") + F.floor(F.col("k") / F.col("each"))).alias("sequence_id"),
        (F.col("offset") + F.col("k") % F.col("each") * F.col("length")).alias("offset"))

    before = counted.select("__length", "__salt", (F.sum("__n").over(
        W.partitionBy("__length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    ranked = salted.withColumn("__own", F.row_number().over(W.partitionBy("__length", "__salt").orderBy(*order)))
    ranked = ranked.join(before, ["__length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__own") - 1)
    return ranked.join(slots, ["__length", "__rank"]).select(*[F.col(f"`{c}`") for c in df.columns], "sequence_id", "offset")
