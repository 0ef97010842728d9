"""Fill-in-middle transformation (operator 11): texts cut into prefix, middle and suffix, and put together again.

All work is on the UTF-8 bytes of a text. ``Exceptions`` is a sparse index of it that has an entry for each
multibyte character and none for ASCII: a binary search counts the excess bytes before a cut, and between
entries code points and bytes differ by that constant. So a byte cut gets its code point and a code-point
cut its byte without decoding, and pure ASCII texts need neither.

Two numbers drawn from the row's key place the cuts, a third decides whether a text is transformed, a fourth
in which order its parts go. The key alone decides, so repeated runs, lost executors and other partitions
give the same output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.llm.shared import SPACE_CHARS

#: Characters of output that a worker gathers before it hands them on.
OUTPUT_BYTES = 16 * 1024 * 1024

UNITS = ("tokens", "characters")

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_CHARS.encode())] = True


class Markers(NamedTuple):
    """Begins with ``<`` and ends with ``>``, so that none can overlap another or come about at a cut."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


MARKERS = Markers()


class Exceptions:
    """Multibyte characters of a UTF-8 text: where they start, and the excess bytes up to and with each."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        self.excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        before = np.concatenate(([0], self.excess[:-1])) if len(lead) else self.excess
        self.characters = self.bytes - before

    def _before(self, places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        n = np.searchsorted(places, cuts)
        return np.where(n > 0, self.excess[n - 1], 0) if len(places) else np.zeros(len(cuts), np.int64)

    def to_characters(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before byte cuts, which lie between characters."""
        return cuts - self._before(self.bytes, cuts)

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before code-point cuts."""
        return cuts + self._before(self.characters, cuts)

    @property
    def n_characters(self) -> int:
        return self.size - int(self.excess[-1]) if len(self.excess) else self.size


def token_ends(data: np.ndarray) -> np.ndarray:
    """Bytes at which tokens end: words with the white space before them, and white space at the end."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _IS_SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(data))


def draws(key: str) -> tuple[int, int, int, int]:
    """The first four groups of 8 hex digits of the key's SHA-256."""
    head = hashlib.sha256(key.encode()).digest()[:16]
    return tuple(int.from_bytes(head[i:i + 4], "big") for i in range(0, 16, 4))


class Cut(NamedTuple):
    n: int
    form: str
    prefix: int | None  # code points
    middle: int | None
    output: bytes


def transform(data: bytes, key: str, percent: int, spm_percent: int, units: str = "tokens", markers: Markers = MARKERS) -> Cut:
    """One text, as UTF-8, cut where ``draws(key)`` says."""
    body = np.frombuffer(data, np.uint8)
    index = None
    if units == "tokens":
        ends = token_ends(body)
        n = len(ends)
    else:
        index = Exceptions(body)
        n = index.n_characters
    h1, h2, h3, h4 = draws(key)
    if not data or h3 % 100 >= percent or any(m.encode() in data for m in markers):
        return Cut(n, "plain", None, None, data)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if units == "tokens":
        at_bytes = np.array([ends[c - 1] if c else 0 for c in (low, high)])
        at = at_bytes if data.isascii() else Exceptions(body).to_characters(at_bytes)
    else:
        at = np.array([low, high])
        at_bytes = index.to_bytes(at)
    first, second = at_bytes.tolist()
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    p, s, m = (mark.encode() for mark in markers)
    if h4 % 100 < spm_percent:
        form, parts = "spm", (s, suffix, p, prefix, m, middle)
    else:
        form, parts = "psm", (p, prefix, s, suffix, m, middle)
    return Cut(n, form, int(at[0]), int(at[1] - at[0]), b"".join(parts))


def transformed(df: DataFrame, seed: str = "42", percent: int = 50, spm_percent: int = 80, units: str = "tokens",
                markers: Markers = MARKERS, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``n`` counts units: ``tokens`` (words with the white space before them, white space at the end) or
    ``characters``. ``percent`` of the texts are transformed, ``spm_percent`` of these to suffix, prefix,
    middle, the others to prefix, suffix, middle. Empty texts and those that contain a marker stay plain,
    with NULL for both lengths.

    Every row stays, repeated ones too (with equal outputs, as the id alone decides), with all its columns;
    ``prefix`` keeps the new names apart from existing ones. A NULL text is empty; a NULL id is drawn for
    like an empty one. An empty table gives none.
    """
    if units not in UNITS:
        raise ValueError(f"units must be one of {UNITS}, not {units!r}")
    if len({*markers}) < 3 or not all(m[:1] == "<" and m[-1:] == ">" and m[1:-1].isalnum() for m in markers):
        raise ValueError(f"markers must be three different names in angle brackets, not {markers}")
    names = [f"{prefix}{name}" for name in ("n", "form", "prefix_chars", "middle_chars", "output")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    kind = ", ".join(f"{name}:{t}" for name, t in zip(names, ("bigint", "string", "bigint", "bigint", "string"), strict=True))

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            done, chunks, size = [], [], 0

            def struct(rows: list[Cut]) -> pa.StructArray:
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                outputs = pa.array(columns[4], pa.binary()).cast(pa.string())
                arrays = [pa.array(c, t) for c, t in zip(columns[:4], types[:4], strict=True)]
                return pa.StructArray.from_arrays([*arrays, outputs], names=names)

            # as bytes: texts need no decoding
            for key, text in zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
                row = transform(text or b"", f"{seed}:{'' if key is None else key}", percent, spm_percent, units, markers)
                done.append(row)
                size += len(row.output)
                if size > OUTPUT_BYTES:
                    chunks.append(struct(done))
                    done, size = [], 0
            yield pa.concat_arrays([*chunks, struct(done)])

    cut_udf = F.arrow_udf(cut, f"struct<{kind}>")
    return df.select("*", F.inline(F.array(cut_udf(F.col(id_col), F.col(text_col)))))


def restored(output: Column, form: Column, markers: Markers = MARKERS) -> Column:
    """The text from its output and form alone: what stands between the markers, in its old order."""
    def between(before: str, after: str | None) -> Column:
        rest = F.split_part(output, F.lit(before), F.lit(2))
        return F.split_part(rest, F.lit(after), F.lit(1)) if after else rest

    p, s, m = markers
    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
