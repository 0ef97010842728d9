"""BPE ids of texts.

A tokenizer that drops white space between words gives a text the ids of its parts between spaces, one after
the other, so the library encodes each distinct part once per worker and texts are put together from those.
That holds for one family of tokenizers, which its settings show (``splits_words``); with any other the
library encodes and decodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts that a worker remembers; when they are this many it starts anew.
MAX_PARTS = 150_000

# How the tokenizer splits, spelled out for lower-case Latin-1 text.
_LETTERS, _NUMBERS, _SPACES = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


# The settings of tokenizers that ``split`` knows.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}


@lru_cache(maxsize=8)
def splits_words(path: str) -> bool:
    """Whether the tokenizer encodes a text as its parts between spaces, one by one."""
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    return (
        (settings["normalizer"] or {}).get("normalizers") == _NORMALIZERS
        and (settings["pre_tokenizer"] or {}).get("pretokenizers") == _PRE_TOKENIZERS
        and settings["post_processor"] is None and settings["decoder"] is None
        and {k: settings["model"].get(k) for k in _MODEL} == _MODEL
        and all(t["special"] and t["content"].startswith("<|") for t in settings["added_tokens"])
    )


def split(text: str) -> list[str]:
    """Parts that the tokenizer treats one by one: its own ones for Latin-1, else what stands between spaces."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ").replace("\t", " ").split(" ")
    if "<|" in text:  # special tokens are found before anything else
        return text.replace("\n", " ").replace("\t", " ").split(" ")
    return _LATIN.findall(text.lower())


class WordEncoder(dict):
    """part -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, max_parts: int = MAX_PARTS):
        super().__init__()
        self.max_parts = max_parts
        self.by_parts = splits_words(path)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.ends_word = np.array([t.endswith("</w>") for t in self.tokens])

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self._library(part).tobytes()
        return ids

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; what is new in some of them goes through the library in one call."""
        if not self.by_parts:
            yield from (self._library(text).tobytes() for text in texts)
            return
        for low, high in grouped(texts):
            if len(self) > self.max_parts:
                self.clear()
            parts = [split(text) for text in texts[low:high]]
            # in lower case and without marks a word is one run of tokens up to a word end
            new = sorted(part for part in set(filterfalse(self.__contains__, chain.from_iterable(parts))) if part.isalpha() and part.islower())
            ids = self._library(" ".join(new))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(new):
                data, at = ids.tobytes(), 0
                for part, end in zip(new, (4 * ends).tolist(), strict=True):
                    self[part] = data[at:end]
                    at = end
            yield from (b"".join(map(self.__getitem__, own)) for own in parts)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """As the library does; without a decoder that is tokens joined by spaces."""
        if not self.by_parts:
            return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def grouped(texts: list[str], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``size`` characters each."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total > size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


@lru_cache(maxsize=2)
def encoder(path: str, max_parts: int = MAX_PARTS) -> WordEncoder:
    return WordEncoder(path, max_parts)
