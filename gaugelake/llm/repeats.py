"""Windows that repeat across documents, found by minimisers.

The minimiser of a window is the least hash of its ``core`` consecutive units. Equal windows have equal
minimisers, and consecutive windows mostly share theirs, so they travel together as one super-k-mer.

1. Minimisers that occur in one document only are found first, by an aggregate; their windows cannot repeat.
2. Super-k-mers of the others travel to the bucket of their minimiser, equal ones of a batch once. A
   minimiser of very many documents is divided by a second one with other hashes.
3. A bucket tells for each distinct super-k-mer which of its windows also start in a smaller document.
4. That goes to where the super-k-mer occurs, and then to the documents.

Copies of a whole text are left out of 2 and 3: all their windows also start in the smallest of them.

What is found travels by (id, text), never by the id alone: ids may be missing or repeated, and then only
tell which document is smaller.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm.shared import sort_id, splits, stored

#: Documents from which on a minimiser is divided.
HOT_DOCS = 50_000
#: Bytes of super-k-mers that a bucket task works on at once, unless one minimiser has more.
BLOCK_BYTES = 1_000_000


class Kind(Protocol):
    width: int

    def units(self, text: str) -> Any: ...

    def minimisers(self, units: Any, seed: int) -> np.ndarray:
        """One for each window; none if the text is too short."""

    def body(self, units: Any, first: int, last: int) -> bytes:
        """Windows ``first`` to ``last - 1``."""

    def repeats(self, bodies: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(body, first, last) of runs of windows that also start in a body with a smaller owner."""


def runs_of(dup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end positions of the runs of True."""
    edge = np.diff(np.concatenate([[0], dup.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _shared(docs: DataFrame, kind: Kind, hot_docs: int) -> DataFrame:
    """``h`` and ``is_hot`` of the minimisers that more than one document has.

    Aggregated before the shuffle, so that a minimiser of all documents reaches it as one row per task.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            texts = {own: text for own, text in zip(zip(ids.tolist(), keys.tolist(), strict=True), batch.column(1), strict=True)}
            found = [np.unique(kind.minimisers(kind.units(text.as_py()), 0)) for text in texts.values()]
            h = np.concatenate([np.zeros(0, np.uint64), *found])
            doc = np.repeat(np.array([own[0] for own in texts], np.int64), [len(f) for f in found])
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(h))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first].view(np.int64)), pa.array(doc[first]), pa.array(doc[ends[:len(first)] - 1]),
                 pa.array((ends[:len(first)] - first).astype(np.int64))], names=["h", "low", "high", "n"])

    rows = docs.select("doc_id", "text", "tkey").mapInArrow(read, "h bigint, low bigint, high bigint, n bigint")
    return rows.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).filter(
        "low < high").select("h", (F.col("n") >= hot_docs).alias("is_hot"))


def _occurring(docs: DataFrame, kind: Kind) -> DataFrame:
    """``h``, ``doc``, ``tkey`` and ``others``: the distinct minimisers of each batch with the texts that have them."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, found, seen = batch.column(0).to_numpy(), batch.column(2).to_numpy(), [], set()
            for own, text in zip(zip(ids.tolist(), keys.tolist(), strict=True), batch.column(1), strict=True):
                again = own in seen
                seen.add(own)
                found.append(np.zeros(0, np.uint64) if again else np.unique(kind.minimisers(kind.units(text.as_py()), 0)))
            h = np.concatenate(found) if found else np.zeros(0, np.uint64)
            row = np.repeat(np.arange(len(ids)), [len(f) for f in found])
            order = np.lexsort((ids[row], h))
            h, doc, tkey = h[order], ids[row[order]].astype(np.int64), keys[row[order]].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(h)))
            rest = np.ones(len(h), bool)
            rest[first] = False
            other = pa.StructArray.from_arrays([pa.array(doc[rest]), pa.array(tkey[rest])], names=["doc", "tkey"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes - 1)]).astype(np.int32)), other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first].view(np.int64)), pa.array(doc[first]), pa.array(tkey[first]), lists], names=["h", "doc", "tkey", "others"])

    rows = docs.select("doc_id", "text", "tkey").mapInArrow(read, "h bigint, doc bigint, tkey bigint, others array<struct<doc:bigint,tkey:bigint>>")
    return rows.withColumn("others", F.when(F.size("others") > 0, F.col("others")))


FOUND = {"h": pa.int64(), "key": pa.int64(), "body": pa.binary(), "n": pa.int32(), "doc_id": pa.int64(), "tkey": pa.int64(), "start": pa.int32()}


def _super_kmers(docs: DataFrame, kind: Kind) -> DataFrame:
    """From documents with ``hs`` (minimisers to follow) and ``hot`` (those to divide).

    One row for each place of a super-k-mer; its ``body`` comes once in a batch. (h, key) stand for it.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sent, size = [], set(), 0
            for doc_id, text, tkey, hs, hot in zip(*[batch.column(i) for i in range(5)], strict=True):
                units = kind.units(text.as_py())
                h = kind.minimisers(units, 0)
                if not len(h):
                    continue
                divided = h
                if len(hot.values):
                    second = kind.minimisers(units, 1)
                    divided = np.where(np.isin(h, hot.values.to_numpy().view(np.uint64)), h ^ (second << np.uint64(1)), h)
                cut = np.flatnonzero(np.concatenate([[True], (divided[1:] != divided[:-1]) | (h[1:] != h[:-1])]))
                ends = np.append(cut[1:], len(h))
                kept = np.isin(h[cut], hs.values.to_numpy().view(np.uint64))
                doc, own = doc_id.as_py(), tkey.as_py()
                for a, b, d in zip(cut[kept].tolist(), ends[kept].tolist(), divided[cut[kept]].view(np.int64).tolist(), strict=True):
                    body = kind.body(units, a, b)
                    key = (d, xxhash.xxh3_64_intdigest(body) - 2**63)
                    size += 50
                    if key in sent:
                        rows.append((*key, None, b - a, doc, own, a))
                    else:
                        sent.add(key)
                        rows.append((*key, body, b - a, doc, own, a))
                        size += len(body)
                if size > 6_000_000:
                    yield _rows(rows, FOUND)
                    rows, sent, size = [], set(), 0
            yield _rows(rows, FOUND)

    schema = "h bigint, key bigint, body binary, n int, doc_id bigint, tkey bigint, start int"
    return docs.select("doc_id", "text", "tkey", "hs", "hot").mapInArrow(read, schema)


def _rows(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _judged(bodies: DataFrame, kind: Kind) -> DataFrame:
    """``h``, ``key``, ``owner`` and ``runs`` (windows of the owner that also start in a smaller document), where any document has a repeat."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a minimiser's only super-k-mer has nothing to be compared with: its owner has no repeats
        rows, alone, group, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            h, key, bodies, owners, lasts = zip(*rows, *alone, strict=True) if rows or alone else [()] * 5
            owner, last_doc = np.array(owners, np.int64), np.array(lasts, np.int64)
            n = len(rows)
            which, first, end = map(np.asarray, kind.repeats(list(bodies[:n]), owner[:n])) if rows else [np.zeros(0, np.int64)] * 3
            at = np.searchsorted(which, np.arange(len(owner) + 1)).astype(np.int32)
            run = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["first", "last"])
            out = pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(key, pa.int64()), pa.array(owner), pa.ListArray.from_arrays(pa.array(at), run)],
                names=["h", "key", "owner", "runs"])
            return out.filter(pa.array((last_doc > owner) | (at[1:] > at[:-1])))

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if group and row[0] != group[0][0]:
                    (rows if len(group) > 1 else alone).extend(group)
                    group = []
                    if size > BLOCK_BYTES:
                        yield done()
                        rows, alone, size = [], [], 0
                group.append(row)
                size += len(row[2])
        (rows if len(group) > 1 else alone).extend(group)
        yield done()

    return bodies.mapInArrow(judge, "h bigint, key bigint, owner bigint, runs array<struct<first:int,last:int>>")


def with_repeats(df: DataFrame, kind: Kind, id_col: str = "doc_id", text_col: str = "text", hot_docs: int = HOT_DOCS,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` (NULL ids as the largest), ``text``, ``is_copy``, ``windows`` and ``carried`` of each row of ``df``.

    ``carried`` is a struct of the columns ``carry``, for callers that go on with whole rows.

    ``windows`` are ranges of window positions [first, last) that also start in a document with a
    smaller id, in any order and overlapping; for a copy (its whole text is a smaller document's) they
    are not listed. Rows of one id are one document: they repeat nothing of each other.
    """
    whole = df.select(sort_id(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                      F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in carry]).alias("carried"))
    whole = whole.withColumn("tkey", F.xxhash64("text"))
    docs = whole.drop("carried")

    named = docs.select("doc_id", "tkey", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("sha"))
    owners = named.groupBy("sha").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last")
    copies = named.join(owners, "sha").filter("doc_id > owner").select("doc_id", "tkey").distinct()
    copies = stored(copies, "repeats-copies")

    # a join, which adaptive execution splits where one minimiser is in very many documents
    shared = stored(_shared(docs, kind, hot_docs), "repeats-shared")
    hits = _occurring(docs, kind).join(shared, "h").select("h", "is_hot", F.inline(F.concat(
        F.array(F.struct("doc", "tkey")), F.coalesce("others", F.array().cast("array<struct<doc:bigint,tkey:bigint>>")))))
    hits = stored(hits.select(F.col("doc").alias("doc_id"), "tkey", "h", "is_hot"), "repeats-minimisers")

    # sets, for repeated rows have the same
    info = hits.select("doc_id", "tkey", "h", "is_hot", F.lit(False).alias("is_copy")).unionByName(
        copies.select("doc_id", "tkey", F.lit(None).cast("bigint").alias("h"), F.lit(False).alias("is_hot"), F.lit(True).alias("is_copy")))
    info = info.groupBy("doc_id", "tkey").agg(
        F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("is_hot"), F.col("h"))).alias("hot"), F.bool_or("is_copy").alias("is_copy"))
    found = _super_kmers(docs.join(info.filter(~F.col("is_copy")), ["doc_id", "tkey"]), kind)
    found = stored(found, "repeats-super-kmers")

    bodies = found.select("h", "key", "body", "doc_id").repartition(splits(df), "h").groupBy("h", "key").agg(
        F.max("body").alias("body"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    bodies = bodies.sortWithinPartitions("h").select("h", "key", "body", "owner", "last")
    judged = stored(_judged(bodies, kind), "repeats-judged")

    uses = found.drop("body").join(judged, ["h", "key"])
    ranges = F.when(F.col("doc_id") > F.col("owner"), F.array(F.struct(F.lit(0).alias("first"), F.col("n").alias("last")))).otherwise(F.col("runs"))
    spans = uses.select("doc_id", "tkey", "start", F.explode(ranges).alias("r"))
    spans = spans.select("doc_id", "tkey", F.struct((F.col("start") + F.col("r.first")).alias("first"), (F.col("start") + F.col("r.last")).alias("last")).alias("span"))
    marks = spans.unionByName(copies.select("doc_id", "tkey", F.struct(
        F.lit(-1).alias("first"), F.lit(-1).alias("last")).alias("span"))).groupBy("doc_id", "tkey").agg(F.collect_set("span").alias("spans"))
    marks = stored(marks, "repeats-marks")
    out = whole.join(marks, ["doc_id", "tkey"], "left")
    own = F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))
    return out.select("doc_id", "text", F.exists(own, lambda s: s["first"] < 0).alias("is_copy"), F.filter(own, lambda s: s["first"] >= 0).alias("windows"), "carried")
