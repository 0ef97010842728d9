"""URL filters (operator 7): a trie over reversed host labels, then path segments.

A rule fits its host and all subdomains where the path starts with the rule's path. Of the rules that
fit, the one with most host labels wins, then the one with the longest path; of an allow and a block
rule in the same place, block wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.functions.barrier import computed_once

#: Rules with more text than this are joined instead of broadcast.
MAX_TRIE_BYTES = 16_000_000


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


def rule_of(verdict: str, place: str) -> UrlRule:
    """``rule_of("block", "com/de/")``: host up to the first ``/``, path from it on."""
    host, slash, rest = place.partition("/")
    return UrlRule(verdict, host.lower(), slash + rest)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are dicts. A host node has labels as keys and its path root under ``"/"``, which no label
    contains. A path node has whole segments as keys, and under ``None`` the rules that end inside the
    next segment: (prefix of it, verdict, place), longest first."""

    def __init__(self, rules: Iterable[UrlRule]):
        self.root: dict = {}
        for rule in sorted(set(rules)):  # block after allow
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            *whole, part = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = {prefix: (prefix, verdict, place) for prefix, verdict, place in node.get(None, ())}
            ends[part] = (part, rule.verdict, rule.host + rule.path)
            node[None] = sorted(ends.values(), key=lambda end: -len(end[0]))

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, place) of the rule that wins, if one fits."""
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            found = self._below(node.get("/"), path) or found
        return found

    @staticmethod
    def _below(node: dict | None, path: str) -> tuple[str, str] | None:
        found = None
        for segment in path.split("/"):
            if node is None:
                break
            found = next((end[1:] for end in node.get(None, ()) if segment.startswith(end[0])), found)
            node = node.get(segment)
        return found


def judged(df: DataFrame, rules: Iterable[UrlRule], url_col: str = "url", default: str = "allow",
           prefix: str = "", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` (``default`` where no rule fits).

    Every row stays, with all its columns; ``prefix`` keeps the new names apart from existing ones.
    A NULL url, or one without ``://``, has an empty host and path, which only ``default`` judges.
    """
    rules = sorted({UrlRule(v, h.lower(), p) for v, h, p in rules})
    out = df.select("*", host_of(F.col(url_col)).alias(f"{prefix}host"), path_of(F.col(url_col)).alias(f"{prefix}path"))
    size = sum(len(r.host.encode()) + len(r.path.encode()) for r in rules)
    judge = _by_trie if size <= max_trie_bytes else _by_join
    return judge(out, rules, f"{prefix}host", f"{prefix}path", f"{prefix}rule", f"{prefix}verdict", default)


def _by_trie(df: DataFrame, rules: list[UrlRule], host: str, path: str, rule: str, verdict: str, default: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        longest = shared.value.longest
        for hosts, paths in batches:
            found = [longest(h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [place for _, place in found], "verdict": [v for v, _ in found]}, dtype=object)

    out = computed_once(df, __found=walk(host, path))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__found.rule").alias(rule), F.col("__found.verdict").alias(verdict))


def _by_join(df: DataFrame, rules: list[UrlRule], host: str, path: str, rule: str, verdict: str, default: str) -> DataFrame:
    """The same for rules of any size: the distinct places meet the rules by host suffix and whole segments."""
    table = df.sparkSession.createDataFrame(rules, "__verdict string, __host string, __start string").select(
        "*", F.substring_index("__start", "/", -1).alias("__part"),
        F.regexp_extract("__start", r"(?s)^(.*/)?", 1).alias("__whole"))
    places = df.select(F.col(host).alias("__h"), F.col(path).alias("__p")).distinct()
    labels, segments = F.split("__h", r"\.", -1), F.split("__p", "/", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    heads = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice(segments, 1, n), "/"), F.lit("/"))))
    keyed = places.select("*", F.explode(suffixes).alias("__host")).select("*", F.explode(heads).alias("__whole"))
    fits = keyed.join(table, ["__host", "__whole"]).filter(F.startswith("__p", "__start"))
    best = fits.groupBy("__h", "__p").agg(F.max_by(
        F.struct("__verdict", F.concat("__host", "__start").alias("__place")),
        F.struct(F.length("__host"), F.length("__start"), "__verdict")).alias("__best"))
    joined = df.join(best, (F.col(host) == F.col("__h")) & (F.col(path) == F.col("__p")), "left")
    return joined.select(*[df[f"`{c}`"] for c in df.columns], F.col("__best.__place").alias(rule),
                         F.coalesce("__best.__verdict", F.lit(default)).alias(verdict))
