"""BPE encoding and decoding (operator 6) with content-defined chunk reuse.

A rolling hash over its bytes cuts each text into chunks, so that texts with a passage in common have
chunks in common. Chunks used more than once in the corpus travel to one place by content, are encoded
there once and come back as ids; everything else is encoded where it is read. A chunk's words at both
ends may be halves: each join is encoded again from the last space before it to the first space after
it, where the encodings of both sides agree exactly because the tokenizer drops white space.

Which chunks repeat is told to the readers by a bitmap of fixed size. A false hit only sends a chunk on
the longer way, so results do not depend on its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm.shared import splits, stored, texts
from gaugelake.llm.wordbpe import WordEncoder, encoder, grouped, splits_words

CHUNK_BITS = 11  # a cut every 2048 bytes on average
MIN_CHUNK = 256
BITMAP_BITS = 1 << 26

SEGMENTS = "doc_id bigint, doc_key binary, seg int, chunk binary, body binary, head string, mid binary, tail string"


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions in ``data`` (UTF-8 bytes) before which a chunk may start: 16 bytes decide."""
    h = data.astype(np.uint32)
    for step in (1, 2, 4, 8):
        longer = h.copy()
        longer[step:] += h[:-step] * np.uint32(pow(0x9E3779B1, step, 2**32))
        h = longer
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    cuts = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    cuts = cuts[cuts < len(data)]
    return cuts[(data[cuts] & 0xC0) != 0x80]  # between characters


def chunks(data: bytes, cuts: Iterable[int] | None = None) -> list[bytes]:
    """The chunks of one text; ``cuts`` are positions relative to it, if known already."""
    if cuts is None:
        cuts = cut_points(np.frombuffer(data, np.uint8)).tolist() if len(data) > 16 else ()
    ends = [0]
    for cut in cuts:
        if cut - ends[-1] >= MIN_CHUNK:
            ends.append(cut)
    return [data[a:b] for a, b in zip(ends, [*ends[1:], len(data)], strict=True)]


def chunked(batch: pa.RecordBatch) -> Iterator[tuple[int | None, list[bytes]]]:
    """(doc_id, chunks) of each row; the hash runs over the batch as a whole."""
    text = batch.column(1)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[:offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    view = data.tobytes()
    size = 1 << 21
    found = []
    for at in range(0, len(data), size):  # blocks that stay in the cache, 16 bytes of the one before
        low = max(0, at - 16)
        part = cut_points(data[low:at + size + 1]) + low
        found.append(part[(part > at) & (part <= at + size)])
    cuts = np.concatenate(found) if found else np.zeros(0, np.int64)
    bounds = np.searchsorted(cuts, offsets)
    for i, doc_id in enumerate(batch.column(0).to_pylist()):
        start = int(offsets[i])
        own = cuts[bounds[i]:bounds[i + 1]] - start
        yield doc_id, chunks(view[start:int(offsets[i + 1])], own[own > 16].tolist())


def content_key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _long(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def halves(text: str) -> tuple[str, str | None, str]:
    """(half word in front, text between the outer spaces, half word behind); no space: all in front."""
    head, space, rest = text.partition(" ")
    if not space:
        return head, None, ""
    middle, _, tail = rest.rpartition(" ")
    return head, middle, tail


def rejoined(words: WordEncoder, segments: Iterable[tuple[str, bytes | None, str]]) -> bytes:
    """Ids of a text from those of its segments."""
    out, half = [], ""
    for head, middle, tail in segments:
        if middle is None:
            half += head
        else:
            out += [words.encode(half + head), middle]
            half = tail
    return b"".join([*out, words.encode(half)])


def repeat_bitmap(docs: DataFrame) -> np.ndarray:
    """One bit for each residue of the key of a chunk that is used at least twice."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_long(content_key(c)) for _, cs in chunked(batch) for c in cs if c]
            keys, counts = np.unique(np.array(found, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "uses"])

    repeated = docs.mapInArrow(keys, "key bigint, uses bigint").groupBy("key").agg(F.sum("uses").alias("uses")).filter("uses > 1")
    place = F.pmod(F.col("key"), F.lit(BITMAP_BITS))
    cells = stored(repeated.groupBy(F.floor(place / 32).cast("int").alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(key, {BITMAP_BITS}) % 32 AS INT))")).alias("bits")), "bpe-bitmap").toArrow()
    bitmap = np.zeros(BITMAP_BITS // 32, np.uint32)
    bitmap[cells["cell"].to_numpy()] = cells["bits"].to_numpy().astype(np.uint32)
    return bitmap


def _whole_texts(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for low, high in grouped(rows):
                ids = pa.array(list(words.encode_all(rows[low:high])), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), ids], names=["doc_id", "ids"])

    return encode


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit integers) of each row of ``df``.

    Equal to the library's ids without added special tokens. A NULL text is empty and has no ids;
    repeated rows are returned as often as they come; a NULL id stays NULL. Chunks are used again only where
    the tokenizer's settings say that texts fall apart at spaces; any other tokenizer gets whole texts.
    """
    docs = texts(df, id_col, text_col)
    if not splits_words(path):
        return docs.mapInArrow(_whole_texts(path), "doc_id bigint, ids binary")
    told = docs.sparkSession.sparkContext.broadcast(repeat_bitmap(docs))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bitmap = encoder(path), told.value
        for batch in batches:
            sent: set[bytes] = set()
            rows, plain, size = [], [], 0
            for doc_id, parts in chunked(batch):
                keys = [content_key(c) for c in parts]
                marked = [bool(bitmap[(p := _long(k) % BITMAP_BITS) // 32] >> np.uint32(p % 32) & 1) for k in keys]
                size += sum(map(len, parts))
                if not any(marked):
                    plain.append(b"".join(parts).decode())
                    rows.append([doc_id, None, 0, None, None, "", len(plain) - 1, ""])
                else:
                    doc_key, seg = content_key(b"".join(keys)), 0
                    for mark, run in groupby(zip(parts, keys, marked, strict=True), key=lambda x: x[2]):
                        if mark:
                            for chunk, key, _ in run:
                                rows.append([doc_id, doc_key, seg, key, None if key in sent else chunk, None, None, None])
                                sent.add(key)
                                seg += 1
                        else:
                            head, middle, tail = halves(b"".join(chunk for chunk, *_ in run).decode())
                            if middle is not None:
                                plain.append(middle)
                                middle = len(plain) - 1
                            rows.append([doc_id, doc_key, seg, None, None, head, middle, tail])
                            seg += 1
                if size > 4_000_000:
                    yield _batch(rows, list(words.encode_all(plain)))
                    rows, plain, size = [], [], 0
            yield _batch(rows, list(words.encode_all(plain)))

    out = stored(docs.mapInArrow(read, SEGMENTS), "bpe-segments")
    whole = out.filter("doc_key IS NULL").select("doc_id", F.col("mid").alias("ids"))

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            done = [halves(body.decode()) for body in batch.column(1).to_pylist()]
            ids = words.encode_all([middle or "" for _, middle, _ in done])
            done = [(head, None if middle is None else own, tail) for (head, middle, tail), own in zip(done, ids, strict=True)]
            head, mid, tail = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(head, pa.string()), pa.array(mid, pa.binary()),
                                              pa.array(tail, pa.string())], names=["chunk", "head", "mid", "tail"])

    uses = out.filter("chunk IS NOT NULL")
    once = uses.filter("body IS NOT NULL").groupBy("chunk").agg(F.any_value("body").alias("body")).mapInArrow(
        encode_chunks, "chunk binary, head string, mid binary, tail string")
    joined = uses.select("doc_id", "doc_key", "seg", "chunk").join(once, "chunk").drop("chunk")
    plain = out.filter("doc_key IS NOT NULL AND chunk IS NULL").select(*joined.columns)
    parts = joined.unionByName(plain).repartition(splits(df), "doc_id", "doc_key").sortWithinPartitions("doc_id", "doc_key", "seg")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        own, own_key, ids, out_ids, size = [], None, [], [], 0

        def close() -> None:
            nonlocal size
            # equal rows have equal segments: one of each makes the text, their number the rows
            copies = sum(seg == 0 for seg, *_ in own)
            first = {seg: rest for seg, *rest in own}
            joined = rejoined(words, [first[seg] for seg in sorted(first)])
            ids.extend([own_key[0]] * copies)
            out_ids.extend([joined] * copies)
            size += copies * len(joined)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "doc_key", "seg", "head", "mid", "tail")]
            for doc_id, doc_key, *rest in zip(*columns, strict=True):
                if (doc_id, doc_key) != own_key:
                    if own:
                        close()
                    own, own_key = [], (doc_id, doc_key)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out_ids, pa.binary())], names=["doc_id", "ids"])
                        ids, out_ids, size = [], [], 0
                own.append(rest)
        if own:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out_ids, pa.binary())], names=["doc_id", "ids"])

    return whole.unionByName(parts.mapInArrow(assemble, "doc_id bigint, ids binary"))


def _batch(rows: list[list], ids: list[bytes]) -> pa.RecordBatch:
    """``mid`` of a row is a place in ``ids``."""
    for row in rows:
        row[6] = None if row[6] is None else ids[row[6]]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [()] * 8
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def decoded(df: DataFrame, path: str, ids_col: str = "ids", as_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` as the library decodes it, special tokens kept; NULL stays NULL."""
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = encoder(path)
        for batch in batches:
            yield pa.array([None if ids is None else words.decode(ids) for ids in batch.to_pylist()], pa.string())

    return df.withColumn(as_col, F.arrow_udf(decode, "string")(F.col(ids_col)))
