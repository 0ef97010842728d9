"""MinHash near-dedup (operator 10) with b-bit signatures.

1. Each text becomes the set of its word shingles (64-bit hashes), its minima under many permutations,
   band keys of those, and a signature of their low bits. Equal sets are one node from here on, with a
   number of its own: ids may be missing or repeated and come in again only at the end.
2. Nodes that share a band key meet. Bit counts of their signatures estimate their similarity, corrected
   for low bits that agree by chance; nodes that could be similar fall into one candidate group. A bucket
   returns a spanning forest of its likely pairs, never all of them.
3. Groups meet with whole texts. Exact intersections decide, again leaving a forest of confirmed links.
4. Components over confirmed links.

Buckets and groups beyond a size are dealt out in pairs of blocks, so none of them is one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.llm.components import components
from gaugelake.llm.hashing import mixed, runs_mixed, word_hashes
from gaugelake.llm.shared import MAX_ID, sort_id, splits, stored, texts

BANDS, ROWS = 40, 5
LOW_BITS = 4
#: Standard deviations of the estimate that a similar pair may lie below the threshold.
MARGIN = 6.0
#: Nodes of a bucket, and shingles of a group, that one task compares.
BUCKET_NODES, GROUP_SHINGLES = 20_000, 4_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle, an empty one none."""
    words = text.encode().translate(_LOWER).split()  # bytes split at exactly these white spaces
    if not words:
        return np.zeros(0, np.uint64)
    n = min(width, len(words))
    return np.unique(runs_mixed(word_hashes(words), n, n))


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets, the same in every task."""
    x = mixed(mixed(np.arange(1, 2 * count + 1, dtype=np.uint64)))
    return x[:count] | np.uint64(1), x[count:]


def minima(values: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        h = values[at:at + 512, None] * multipliers[None]
        h += offsets
        np.minimum(low, h.min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint64)


def packed_bits(low: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` of each minimum, one bit plane after the other."""
    planes = (low[None] >> np.arange(bits, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8), axis=1).tobytes()


def estimates(one: np.ndarray, many: np.ndarray, count: int, bits: int) -> np.ndarray:
    """Similarity of one signature (planes x bytes) and many, corrected for chance agreement."""
    differ = np.bitwise_or.reduce(many ^ one, axis=1)
    agree = 1 - np.bitwise_count(differ).sum(1) / count
    chance = 2.0**-bits
    return (agree - chance) / (1 - chance)


def least_estimate(threshold: float, count: int, bits: int, margin: float = MARGIN) -> float:
    chance = 2.0**-bits
    agree = chance + (1 - chance) * threshold
    return threshold - margin * (agree * (1 - agree) / count) ** 0.5 / (1 - chance)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest; ``near(i, open)`` picks those of ``open`` that are linked with ``i``."""
    edges: list[tuple[int, int]] = []
    open_ = np.arange(n)
    while len(open_):
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            i = queue.pop()
            hit = near(i, open_)
            if hit.any():
                found = open_[hit].tolist()
                edges += [(i, j) for j in found]
                queue += found
                open_ = open_[~hit]
    return edges


def in_blocks(df: DataFrame, n_blocks: Column) -> DataFrame:
    """Each row once for each pair of blocks that holds its block, as columns ``low`` and ``high``."""
    own = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    df = df.withColumn("n_blocks", n_blocks.cast("int")).withColumn("own", own)
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    return df.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).drop("own", "other", "n_blocks")


def _edges(rows: DataFrame, keys: list[str], value: str, link: Callable[[list], list[tuple[int, int]]]) -> DataFrame:
    """``link`` over the values of each group of ``keys``; edges (a, b) between nodes."""
    rows = rows.select(*keys, "low", "high", "node", value).repartition(splits(rows), *keys, "low", "high").sortWithinPartitions(
        *keys, "low", "high", "node")
    n = len(keys) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, values, out = None, [], [], []

        def close() -> None:
            if len(nodes) > 1:
                out.extend((nodes[i], nodes[j]) for i, j in link(values))

        def taken() -> pa.RecordBatch:
            a, b = zip(*out, strict=True) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(n + 2)]
            for *own, node, item in zip(*columns, strict=True):
                if own != key:
                    close()
                    key, nodes, values = own, [], []
                elif node == nodes[-1]:  # a repeated row
                    continue
                nodes.append(node)
                values.append(item)
            yield taken()
        close()
        yield taken()

    return rows.mapInArrow(run, "a bigint, b bigint")


def described(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, ``set_key``, ``signature`` and ``bands`` of each text."""
    count = BANDS * ROWS

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, offsets = permutations(count)
        for batch in batches:
            sizes, keys, signatures, bands = [], [], [], []
            for text in batch.column(2):
                values = shingles(text.as_py(), width)
                low = minima(values, multipliers, offsets)
                band = np.arange(1, BANDS + 1, dtype=np.uint64)
                for row in low.reshape(BANDS, ROWS).T:
                    band = mixed(band + row)
                sizes.append(len(values))
                keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                signatures.append(packed_bits(low, LOW_BITS))
                bands.append(band.view(np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), lists],
                names=["doc_id", "text_key", "n_shingles", "set_key", "signature", "bands"])

    return docs.mapInArrow(describe, "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, signature binary, bands array<bigint>")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and ``text_key`` (a hash) of each row of ``df``.

    Texts are linked where 100 * intersection >= ``percent`` * union of their shingle sets. The smallest
    id of a component is its id and is kept; a NULL id counts as the largest and stays NULL. Rows are
    judged one by one: where the smallest id has several texts in a component, as rows without an id may,
    the one with the smallest ``text_key`` is kept, as often as it is repeated. A text without words (NULL,
    empty, white space) is linked with nothing.
    """
    docs = texts(df, id_col, text_col).select(sort_id().alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    count = BANDS * ROWS
    rows = stored(described(docs, width), "minhash-rows")
    nodes = stored(rows.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("low"), F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands")).withColumn(
        "node", F.monotonically_increasing_id()), "minhash-nodes")

    buckets = nodes.select("node", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    met = buckets.join(shared, "band").join(nodes.select("node", "signature"), "node")
    met = in_blocks(met, F.ceil(F.col("n") / BUCKET_NODES))
    least = least_estimate(percent / 100, count, LOW_BITS)

    def likely(signatures: list[bytes]) -> list[tuple[int, int]]:
        all_ = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), LOW_BITS, -1)
        return forest(len(all_), lambda i, open_: estimates(all_[i], all_[open_], count, LOW_BITS) >= least)

    groups = components(_edges(met, ["band"], "signature", likely))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = groups.join(nodes, "node").groupBy("root").agg(F.ceil(F.sum("n_shingles") / GROUP_SHINGLES).alias("blocks"))
    chosen = groups.join(sizes, "root").join(nodes.select("node", "low.*"), "node")
    # of equal texts without an id one is enough
    nameless = docs.filter(F.col("doc_id") == MAX_ID).groupBy("doc_id", "text_key").agg(F.any_value("text").alias("text"))
    members = docs.filter(F.col("doc_id") < MAX_ID).unionByName(nameless).join(chosen, ["doc_id", "text_key"])
    members = in_blocks(members, F.col("blocks"))

    def confirmed(group: list[str]) -> list[tuple[int, int]]:
        sets = [shingles(text, width) for text in group]
        sizes = np.array([len(s) for s in sets])
        _, dense = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(int(dense.max(initial=-1)) + 1, bool)

        def near(i: int, open_: np.ndarray) -> np.ndarray:
            hit = np.zeros(len(open_), bool)
            fits = (sizes[open_] * 100 >= percent * sizes[i]) & (sizes[i] * 100 >= percent * sizes[open_]) & (sizes[open_] > 0)
            some = open_[fits]
            if not len(some) or not sizes[i]:
                return hit
            own = dense[starts[i]:starts[i + 1]]
            mark[own] = True
            lengths = sizes[some]
            ends = np.cumsum(lengths)
            at = np.repeat(starts[some] - (ends - lengths), lengths) + np.arange(ends[-1])
            both = np.add.reduceat(mark[dense[at]].astype(np.int64), ends - lengths)
            mark[own] = False
            hit[fits] = 100 * both >= percent * (sizes[i] + lengths - both)
            return hit

        return forest(len(sets), near)

    labels = components(_edges(members, ["root"], "text", confirmed))
    labels = labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())
    lowest = nodes.join(labels, "node").groupBy("root").agg(F.min("low").alias("lowest"))
    found = nodes.select("set_key", "node", "low").join(labels.join(lowest, "root"), "node", "left")
    out = rows.join(found.select("set_key", F.coalesce("lowest", "low").alias("low")), "set_key", "left")
    return out.select(
        F.nullif("doc_id", F.lit(MAX_ID)).alias("doc_id"), "n_shingles",
        F.nullif(F.coalesce("low.doc_id", "doc_id"), F.lit(MAX_ID)).alias("component_id"),
        F.coalesce((F.col("doc_id") == F.col("low.doc_id")) & (F.col("text_key") == F.col("low.text_key")), F.lit(True)).alias("kept"),
        "text_key")
