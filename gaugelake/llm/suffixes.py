"""Suffix-array dedup (operator 4): bytes covered by long strings that also start in a smaller document.

Super-k-mers of bytes bring equal strings together (``repeats``). There a suffix array of the block is
built in two stages: suffixes smaller than their successors are sorted directly, all others are induced
from them by scanning buckets of first bytes. Neighbours in it with a common prefix of the full width
are equal strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake.llm.hashing import mixed, sliding_min
from gaugelake.llm.repeats import HOT_DOCS, runs_of, with_repeats
from gaugelake.llm.shared import MAX_ID

CORE = 16
SEPARATOR = 0xFF  # no byte of UTF-8


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one big-endian number; ``data`` ends in 8 more."""
    n = len(data) - 8
    return np.ndarray((n,), ">u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def padded_words(data: np.ndarray, depth: int) -> np.ndarray:
    return words_at(np.concatenate([data, np.zeros(depth + 16, np.uint8)]))


def sorted_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the ``depth`` bytes from there; only what ties is compared further."""
    group = np.zeros(len(at), np.int64)
    order = np.arange(len(at))
    open_ = np.arange(len(at))  # places in ``order`` that still tie with a neighbour
    for k in range(0, depth, 8):
        key = words[at[order[open_]] + k]
        if k + 8 > depth:
            key = key >> np.uint64(8 * (k + 8 - depth))
        sub = np.lexsort((key, group[open_])) if k else np.argsort(key, kind="stable")
        order[open_] = order[open_][sub]
        key, own = key[sub], group[open_][sub]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]) if len(key) else np.zeros(0, bool)
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else group[open_]
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        if not len(open_):
            break
    return at[order]


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """Positions of ``data`` in the order of their suffixes, exact to ``depth`` bytes.

    With ``wanted`` (marks), only those positions and what they are induced from: each one's run of
    suffixes up to the next that is smaller than its successor.
    """
    n = len(data)
    if n < 2:
        return np.arange(n)
    words = padded_words(data, depth) if words is None else words
    differs = np.append(data[:-1] != data[1:], True)
    after = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    follows = np.append(data[1:], 0).astype(np.int16)
    follows[-1] = -1
    small = data[after] < follows[after]  # smaller than its successor

    needed = np.ones(n, bool)
    if wanted is not None:
        base = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
        edge = np.bincount(np.flatnonzero(wanted), minlength=n + 2) - np.bincount(base[wanted] + 1, minlength=n + 2)
        needed = np.cumsum(edge)[:n] > 0
    skip = small | ~needed

    direct = sorted_directly(words, np.flatnonzero(small & needed), depth)
    bounds = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not skip[-1]:
        waiting[data[-1]].append(np.array([n - 1]))  # induced by the empty suffix
    large_at = np.flatnonzero(~skip)
    by_byte = large_at[np.argsort(data[large_at], kind="stable")]
    large_bounds = np.searchsorted(data[by_byte], np.arange(257))
    out = []
    for byte in range(256):
        large = large_bounds[byte + 1] - large_bounds[byte]
        pieces = waiting[byte]
        new = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        pieces, size, rounds = [new], len(new), 0
        while len(new) and size < large:
            before = new[new > 0] - 1
            new = before[(data[before] == byte) & ~skip[before]]
            rounds += 1
            if rounds > depth:  # all that is left starts with ``depth`` equal bytes
                rest = by_byte[large_bounds[byte]:large_bounds[byte + 1]]
                new = np.setdiff1d(rest, np.concatenate(pieces))
            pieces.append(new)
            size += len(new)
        whole = np.concatenate([*pieces, direct[bounds[byte]:bounds[byte + 1]]])
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[~skip[before] & (data[before] > byte)]
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cut) if len(before) else ():
            waiting[data[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix of ``order`` and the one before it have ``width`` bytes in common."""
    a, b = order[1:], order[:-1]
    same = np.ones(len(a), bool)
    for k in [*range(0, width - 7, 8), width - 8]:
        same &= words[a + k] == words[b + k]
    return np.concatenate([[False], same])


class ByteWindows:
    def __init__(self, width: int):
        if width < CORE:
            raise ValueError(f"strings are at least {CORE} bytes long")
        self.width = width

    def units(self, text: str) -> bytes:
        return text.encode()

    def minimisers(self, units: bytes, seed: int) -> np.ndarray:
        if len(units) < self.width:
            return np.zeros(0, np.uint64)
        words = words_at(np.frombuffer(units + b"\0", np.uint8))
        h = mixed(mixed(words[:-8] + np.uint64(seed)) + words[8:])
        return sliding_min(h, self.width - CORE + 1)

    def body(self, units: bytes, first: int, last: int) -> bytes:
        return units[first:last + self.width - 1]

    def repeats(self, bodies: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(b) + 1 for b in bodies])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(bytes([SEPARATOR]).join(bodies) + bytes([SEPARATOR]), np.uint8)
        body = np.repeat(np.arange(len(bodies)), sizes)
        whole = np.arange(len(data)) + self.width <= (starts + sizes - 1)[body]  # inside one super-k-mer
        words = padded_words(data, self.width)
        order = suffix_array(data, self.width, whole, words)
        order = order[whole[order]]
        common = common_prefixes(words, order, self.width)
        group = np.cumsum(~common) - 1
        owner = owners[body[order]]
        least = np.minimum.reduceat(owner, np.flatnonzero(~common))[group]
        dup = np.zeros(len(data), bool)
        dup[order] = least < owner
        first, last = runs_of(dup)
        return body[first], first - starts[body[first]], last - starts[body[first]]


def removed_runs(windows: list[tuple[int, int]], width: int) -> list[list[int]]:
    """Maximal ranges of units covered by the windows that start in the ranges given."""
    runs: list[list[int]] = []
    for first, last in sorted(windows):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last + width - 1)
        else:
            runs.append([first, last + width - 1])
    return runs


def without_repeats(df: DataFrame, width: int = 50, whole_characters: bool = False, id_col: str = "doc_id",
                    text_col: str = "text", hot_docs: int = HOT_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (start, end) and ``kept`` (bytes) of each row.

    ``carried`` is a struct of the columns ``carry`` of ``df``. A byte is removed if a string of ``width`` bytes that covers it also starts in a document with a
    smaller id. With ``whole_characters`` runs shrink to whole characters, so that ``kept`` is valid
    UTF-8. A NULL text is empty. Rows of one id are one document; a NULL id counts as the largest and
    stays NULL. Repeated rows are returned as often as they come.
    """
    marked = with_repeats(df, ByteWindows(width), id_col, text_col, hot_docs, carry)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size, done = [], 0, 0
            for doc_id, text, is_copy, windows in zip(*[batch.column(i) for i in range(4)], strict=True):
                data, windows = text.as_py().encode(), [(w["first"], w["last"]) for w in windows.as_py()]
                if is_copy.as_py() and len(data) >= width:
                    windows = [(0, len(data) - width + 1)]
                runs, kept, at = [], [], 0
                for a, b in removed_runs(windows, width):
                    if whole_characters:
                        while a < b and data[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                            b -= 1
                    if a < b:
                        kept.append(data[at:a])
                        runs.append({"start": a, "end": b})
                        at = b
                kept = b"".join([*kept, data[at:]])
                rows.append((doc_id.as_py(), len(data), len(data) - len(kept), len(runs), runs, kept))
                size += len(data)
                if size > 8_000_000:
                    yield batch_of(rows, batch.column(4).slice(done, len(rows)))
                    rows, size, done = [], 0, done + len(rows)
            yield batch_of(rows, batch.column(4).slice(done))

    def batch_of(rows: list[tuple], carried: pa.Array) -> pa.RecordBatch:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
        columns = zip(*rows, strict=True) if rows else [()] * 6
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, carried], names=[*names, "carried"])

    schema = T.StructType.fromDDL(
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    schema = T.StructType([*schema, marked.schema["carried"]])
    return marked.mapInArrow(cut, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(MAX_ID)))
