"""Secret scans (operator 5): patterns, then structural confirmation.

The base kinds (``assign``, ``access``, ``hex``) are reported as they match. Further kinds are reported
only where the candidate decodes to the structure that it pretends to be:

``jwt``     two or three dotted base64url parts whose first one is a JSON object with ``alg``
``pem``     a PEM block whose body is one DER value of exactly its length
``der``     base64 or hex that decodes to a DER SEQUENCE with fitting nested lengths
``sshkey``  base64 with length-prefixed fields, the first being a key type, that end where it ends

Base64 is standard or URL-safe and may follow anything but a letter or digit: ``NAME=``, a path, a mark.
It may be wrapped, with or without PEM lines; line breaks may be escaped or lie between quoted parts.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



# The base kinds, in order.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs: a run that is too short has no match inside
MIN_ASSIGNED, MIN_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "sshkey")

_KEYWORDS = ("passw", "secret", "token", "api")
# No pattern reads a run of characters from more than one place: runs are taken from their start, and kept.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)(?:\.([A-Za-z0-9_-]*+))?")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]++)-----([A-Za-z0-9+/=\s]++)-----END \1-----")
#: Where a value may start: what a DER SEQUENCE, a short first length and the magic of OpenSSH keys look like in base64.
_START = re.compile(r"(?<![A-Za-z0-9])(?:M[A-P]|AAAA|b3BlbnNzaC1rZXktdjE)(?=[A-Za-z0-9+/_-]{20})")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_MORE = re.compile(r"[A-Za-z0-9+/]")
#: What stands for a line break in JSON, YAML or source text: escapes, continued lines, joined string parts.
_ESCAPED = re.compile(r"""(?<!\\)\\++(?:[nrt]|(?=\r?\n))|["'][ \t]*+(?:[+.,][ \t]*+)?\r?\n[ \t]*+(?:[+.][ \t]*+)?["']""")
_BREAK = re.compile(r"[ \t]*+[\r\n]\s*+")
_PADDING = re.compile(r"={0,2}")
_TO_STANDARD = str.maketrans("-_", "+/")
#: Characters that a key has at least, and each line of a wrapped one but the last.
MIN_RUN, MIN_LINE = 40, 20
_HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}")
_OPENSSH = b"openssh-key-v1\0"
_KEY_TYPES = (b"ssh-", b"ecdsa-", b"sk-", b"openssh-key-v1")

Span = tuple[int, int, int]  # start, kind number, end


def decoded(run: str, altchars: bytes | None = None) -> bytes | None:
    """base64, with or without padding."""
    run = run.rstrip("=")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), altchars, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_end(data: bytes, at: int, end: int, depth: int = 0) -> int | None:
    """Where the DER value at ``at`` ends, if its lengths and those nested in it fit."""
    if at + 2 > end or depth > 8:
        return None
    tag, size, body = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or body + n > end:
            return None
        size, body = int.from_bytes(data[body:body + n], "big"), body + n
        if size < 0x80:
            return None
    stop = body + size
    if stop > end:
        return None
    if tag & 0x20:  # constructed: its values fill it exactly
        while body < stop:
            body = der_end(data, body, stop, depth + 1)
            if body is None:
                return None
    return stop


def is_der_sequence(data: bytes | None) -> bool:
    """One SEQUENCE over all of ``data`` with at least one value inside."""
    return bool(data) and len(data) > 20 and data[0] == 0x30 and der_end(data, 0, len(data)) == len(data)


def is_ssh_fields(data: bytes | None) -> bool:
    """Length-prefixed fields, at least two, from a key type to the end."""
    if not data or len(data) < 30:
        return False
    at = fields = 0
    while at + 4 <= len(data) and not data.startswith(_OPENSSH):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data) or (at == 0 and not data[4:4 + size].startswith(_KEY_TYPES)):
            return False
        at, fields = at + 4 + size, fields + 1
    return data.startswith(_OPENSSH) or at == len(data) and fields > 1


def der_size(head: bytes) -> int:
    """Bytes of the DER value that starts with ``head``, as its header says; 0 if there is none."""
    if head[1] < 0x80:
        return 2 + head[1]
    n = head[1] & 0x7F
    return 2 + n + int.from_bytes(head[2:2 + n], "big") if 1 <= n <= 4 else 0


def ends_at(text: str, end: int) -> bool:
    """Whether no base64 goes on at ``end``; URL-safe marks may follow as separators."""
    return not _MORE.match(text, end)


def base64_of(run: str) -> bytes | None:
    """Standard or URL-safe base64, not both mixed."""
    if ("-" in run or "_" in run) and ("+" in run or "/" in run):
        return None
    return decoded(run.translate(_TO_STANDARD))


def plain_breaks(text: str) -> str:
    """``text`` with real line breaks for escaped ones and between parts of strings, every character at its place."""
    if "\\" not in text and '"' not in text and "'" not in text:
        return text
    return _ESCAPED.sub(lambda m: "\n" * len(m[0]), _ESCAPED.sub(lambda m: "\n" * len(m[0]), text))


class Runs:
    """Runs of base64 in a text and the lines on which they go on, each found once."""

    def __init__(self, text: str):
        self.text = text
        self.low = self.high = 0  # the run asked for last
        self.last_standard = self.last_url_safe = -1  # where it has its last marks of either alphabet
        self.following: dict[int, int | None] = {}
        self.ends: dict[int, int] = {}

    def end(self, start: int) -> int:
        """Where the run around ``start`` ends."""
        if not self.low <= start < self.high:
            self.low, self.high = start, self._end(start)
            marks = [[self.text.rfind(m, start, self.high) for m in pair] for pair in ("+/", "-_")]
            self.last_standard, self.last_url_safe = map(max, marks)
        return self.high

    def _end(self, start: int) -> int:
        if start not in self.ends:
            run = _RUN.match(self.text, start)
            self.ends[start] = run.end() if run else start
        return self.ends[start]

    def mixed(self, start: int) -> bool:
        """Whether the run from ``start`` on has marks of both alphabets."""
        self.end(start)
        return min(self.last_standard, self.last_url_safe) >= start

    def lines(self, start: int) -> Iterator[tuple[int, int]]:
        """Start and end of the base64 at ``start`` and of the lines on which it may go on."""
        end = self.end(start)
        while end > start:
            yield start, end
            if end - start < MIN_LINE:
                return
            if end not in self.following:
                more = _BREAK.match(self.text, end)
                self.following[end] = more.end() if more else None
            start = self.following[end]
            if start is None:
                return
            end = self._end(start)


class Decoded:
    """The bytes that the base64 at a place stands for, read where they are asked for."""

    def __init__(self, runs: Runs, start: int):
        self.text, self.start, self.more = runs.text, start, runs.lines(start)
        self.lines: list[tuple[int, int, int]] = []  # start, end, characters before
        self.n = 0

    def reach(self, characters: int) -> bool:
        """Whether there are so many characters."""
        if characters > len(self.text) - self.start:
            return False
        while self.n < characters:
            line = next(self.more, None)
            if line is None:
                return False
            self.lines.append((*line, self.n))
            self.n += line[1] - line[0]
        return True

    def has(self, size: int) -> bool:
        return self.reach(-(-size * 4 // 3))

    def characters(self, low: int, high: int) -> str:
        """Characters ``low`` to ``high``, fewer at the end."""
        self.reach(min(high, len(self.text) - self.start))
        at = bisect.bisect_right(self.lines, low, key=lambda line: line[2]) - 1
        parts = []
        while 0 <= at < len(self.lines) and self.lines[at][2] < high:
            start, end, before = self.lines[at]
            parts.append(self.text[start + max(low - before, 0):min(end, start + high - before)])
            at += 1
        return "".join(parts)

    def bytes(self, low: int, high: int) -> bytes:
        first = low // 3
        part = self.characters(4 * first, 4 * -(-high // 3)).translate(_TO_STANDARD)
        data = decoded(part[:-1] if len(part) % 4 == 1 else part) or b""
        return data[low - 3 * first:high - 3 * first]

    def place(self, characters: int) -> int | None:
        """Where in the text the first ``characters`` end."""
        if not self.reach(characters):
            return None
        start, _, before = self.lines[bisect.bisect_left(self.lines, characters, key=lambda line: line[2]) - 1]
        return start + characters - before


def key_at(runs: Runs, start: int) -> tuple[int, int] | None:
    """Kind number and end (without padding) of the DER value or SSH key whose base64 starts at ``start``."""
    text = runs.text
    head = base64_of(text[start:start + 8])
    if head is None:
        return None
    # most candidates are none by their first bytes; a run too short for that is read line by line
    first = text[start:start + 32] if runs.end(start) - start >= 32 else None
    first = decoded(first.translate(_TO_STANDARD)) if first else None
    if head[0] == 0x30:
        n = -(-der_size(head) * 4 // 3)
        if not MIN_RUN <= n <= len(text) - start or (first and not first_value_fits(first)):
            return None
        if start + n <= runs.end(start):  # on one line
            end = start + n
            return (5, end) if ends_at(text, end) and is_der_sequence(base64_of(text[start:end])) else None
        body = Decoded(runs, start)
        if not body.reach(n) or not first_value_fits(body.bytes(0, 18)):
            return None
        end = body.place(n)
        return (5, end) if end is not None and ends_at(text, end) and is_der_sequence(base64_of(body.characters(0, n))) else None
    if not head.startswith(b"openss") and not (head[:4] < b"\0\0\1\0" and any(k.startswith(head[4:]) for k in _KEY_TYPES)):
        return None
    if first and not first.startswith(_OPENSSH) and not first[4:].startswith(_KEY_TYPES):
        return None
    body = Decoded(runs, start)
    openssh = body.bytes(0, len(_OPENSSH)) == _OPENSSH
    for size in reversed(openssh_ends(body) if openssh else ssh_ends(body)):
        n = -(-size * 4 // 3)
        end = body.place(n)
        if size >= 30 and end is not None and n >= MIN_RUN and ends_at(text, end) and base64_of(body.characters(0, n)) is not None:
            return 6, end
    end = runs.end(start)
    # a private key that is cut short or goes on in another way: its first line
    if openssh and end - start >= MIN_RUN and (end - start) % 4 != 1 and not runs.mixed(start):
        return 6, end
    return None


def first_value_fits(head: bytes) -> bool:
    """Whether the first value inside a DER SEQUENCE that starts with ``head`` ends inside it."""
    outer = der_size(head)
    at = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
    inner = der_size(head[at:]) if at + 2 <= len(head) else 0
    return 0 < inner <= outer - at


def ssh_ends(body: Decoded) -> list[int]:
    """Where the second and each later of the length-prefixed fields ends, the first being a key type."""
    at, ends = 0, []
    while len(head := body.bytes(at, at + 4)) == 4:
        size = int.from_bytes(head, "big")
        if not body.has(at + 4 + size) or (at == 0 and not body.bytes(4, 4 + min(size, 20)).startswith(_KEY_TYPES)):
            break
        at += 4 + size
        ends.append(at)
    return ends[1:]


def openssh_ends(body: Decoded) -> list[int]:
    """Where an OpenSSH private key ends: three fields, a number of public keys, these and the private part."""
    at, left, counted = len(_OPENSSH), 3, False
    while left:
        head = body.bytes(at, at + 4)
        if len(head) < 4 or not body.has(at + 4 + int.from_bytes(head, "big")):
            return []
        at += 4 + int.from_bytes(head, "big")
        left -= 1
        if not left and not counted:
            head = body.bytes(at, at + 4)
            if len(head) < 4:
                return []
            left, at, counted = 1 + int.from_bytes(head, "big"), at + 4, True
    return [at]


def key_spans(text: str) -> list[Span]:
    """DER values and SSH keys in base64, wherever no letter or digit precedes them."""
    found, at, runs = [], 0, Runs(text)
    while m := _START.search(text, at):
        key = key_at(runs, m.start())
        if key is None:
            at = m.start() + 1
            continue
        kind, end = key
        at = _PADDING.match(text, end).end()
        found.append((m.start(), kind, at))
    return found


def is_token_header(part: str) -> bool:
    data = decoded(part, b"-_")
    try:
        header = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[Span]:
    found = []
    lower = text.lower()
    if any(word in lower for word in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[Span]:
    found = []
    if "ey" in text:
        found += [(m.start(), 3, m.end()) for m in _JWT.finditer(text) if is_token_header(m[1])]
    lines = plain_breaks(text)
    if "-----BEGIN " in text:
        for m in _PEM.finditer(lines):
            data = decoded("".join(m[2].split()))
            if is_der_sequence(data) or is_ssh_fields(data):
                found.append((m.start(), 4, m.end()))
    found += key_spans(lines)
    if "30" in text:
        for m in _HEX_DER.finditer(text):
            if len(m[0]) % 2 == 0 and is_der_sequence(bytes.fromhex(m[0])):
                found.append((m.start(), 5, m.end()))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each maximal run of found characters replaced by the kind that starts it."""
    parts, at, last = [], 0, None
    for start, kind, end in spans:
        if last is not None and start < at:
            at = max(at, end)
            continue
        parts += [text[at:start], f"[{KINDS[kind]}]"]
        at, last = end, kind
    return "".join([*parts, text[at:]])


def scanned(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with ``base`` and ``spans`` (``kind:start:end`` by start, then kind) and ``redacted``.

    Positions are code points, ends exclusive. Every row stays, repeated ones too, with all its columns;
    ``prefix`` keeps the new names apart from existing ones. A NULL text is empty: no spans, and its
    redacted text is empty.
    """
    n = [f"{prefix}base", f"{prefix}spans", f"{prefix}redacted", f"{prefix}counts"]
    kind = f"struct<{n[0]}:string,{n[1]}:string,{n[2]}:string,{n[3]}:array<bigint>>"

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text in batch:
                text = text.as_py() or ""
                base = sorted(base_spans(text))
                spans = sorted(base + confirmed_spans(text))
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                for column, value in zip(columns, (joined(base), joined(spans), redacted(text, spans), counts), strict=True):
                    column.append(value)
            yield pa.StructArray.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()),
                 pa.array(columns[3], pa.list_(pa.int64()))], names=n)

    scan_udf = F.arrow_udf(scan, kind)
    return df.select("*", F.inline(F.array(scan_udf(F.col(text_col)))))


