"""Substring dedup (operator 3): words covered by windows that also start in a smaller document.

Super-k-mers of words travel as one packed string to the bucket of their minimiser (``repeats``), where
the windows are sorted: equal ones are neighbours, the first of each has the smallest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm.hashing import runs_mixed, sliding_min, word_hashes
from gaugelake.llm.repeats import HOT_DOCS, with_repeats
from gaugelake.llm.shared import MAX_ID
from gaugelake.llm.suffixes import removed_runs

CORE = 5


class WordWindows:
    def __init__(self, width: int):
        self.width, self.core = width, min(CORE, width)

    def units(self, text: str) -> list[bytes]:
        return text.encode().split()  # bytes split at exactly these white spaces

    def minimisers(self, units: list[bytes], seed: int) -> np.ndarray:
        if len(units) < self.width:
            return np.zeros(0, np.uint64)
        return sliding_min(runs_mixed(word_hashes(units), self.core, seed), self.width - self.core + 1)

    def body(self, units: list[bytes], first: int, last: int) -> bytes:
        return b" ".join(units[first:last + self.width - 1])

    def repeats(self, bodies: list[bytes], owners: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        windows = []
        for i, (body, owner) in enumerate(zip(bodies, owners.tolist(), strict=True)):
            words = body.split(b" ")
            starts, at = [], 0
            for word in words:
                starts.append(at)
                at += len(word) + 1
            starts.append(at)
            windows += [(body[starts[k]:starts[k + self.width] - 1], owner, i, k) for k in range(len(words) - self.width + 1)]
        windows.sort()
        found, last, least = [], None, 0
        for window, owner, i, k in windows:
            if window != last:
                last, least = window, owner
            elif owner > least:
                found.append((i, k))
        found.sort()
        which, first, end = [], [], []
        for i, k in found:
            if which and which[-1] == i and end[-1] == k:
                end[-1] = k + 1
            else:
                which.append(i)
                first.append(k)
                end.append(k + 1)
        return which, first, end


def without_repeats(df: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", hot_docs: int = HOT_DOCS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``spans`` (ranges of word positions) and ``kept`` (words and single spaces).

    A word is removed if a window of ``width`` words that covers it also starts in a document with a
    smaller id. A NULL text has no words. Rows of one id are one document; a NULL id counts as the
    largest and stays NULL. Repeated rows are returned as often as they come.
    """
    marked = with_repeats(df, WordWindows(width), id_col, text_col, hot_docs)
    names = ["doc_id", "n_words", "n_removed", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text, is_copy, windows in zip(*[batch.column(i) for i in range(4)], strict=True):
                words, windows = text.as_py().encode().split(), [(w["first"], w["last"]) for w in windows.as_py()]
                if is_copy.as_py() and len(words) >= width:
                    windows = [(0, len(words) - width + 1)]
                runs = removed_runs(windows, width)
                kept, at = [], 0
                for a, b in runs:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((doc_id.as_py(), len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in runs], b" ".join(kept).decode()))
                size += len(words)
                if size > 1_000_000:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"
    return marked.mapInArrow(cut, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(MAX_ID)))
