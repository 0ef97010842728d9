"""Quality rules (operator 8): one table of thresholds, compiled into one projection.

Measures are Spark SQL expressions over the words and lines of a text; a rule compares two of them in
whole numbers. No user function runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.functions.barrier import computed_once
from gaugelake.llm.shared import SPACE_CHARS, SPACES


class Rule(NamedTuple):
    """A text fails if ``scale * measure`` is beyond ``limit * of`` (``of`` None: beyond ``limit``)."""

    name: str
    measure: str
    beyond: str  # "<" or ">"
    limit: int
    of: str | None = None
    scale: int = 1


# The base rules.
BASE_RULES = (
    Rule("few_words", "n_words", "<", 50),
    Rule("repeated_words", "n_repeat_words", ">", 50, "n_words", 100),
)

#: Lenient on purpose: what they reject is junk in most of its length.
RULES = (
    *BASE_RULES,
    Rule("short_words", "word_chars", "<", 2, "n_words"),
    Rule("long_words", "word_chars", ">", 30, "n_words"),
    Rule("symbols", "n_symbols", ">", 20, "n_words", 100),
    Rule("marks", "n_marks", ">", 20, "n_words", 100),
    Rule("no_stop_words", "n_stop_words", "<", 2, "n_words", 100),
    Rule("dup_lines", "n_dup_lines", ">", 50, "n_lines", 100),
)

STOP_WORDS = {
    "en": "the of and to in is that for it was on are as with be by at this from an or not have".split(),
    "fr": "le la les de des du et en un une est que qui dans pour sur au par il elle ne pas".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "es": "el la los las de del y en que un una es por con para se no al lo como más".split(),
}


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    body = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(body != "", F.split(body, f"[{SPACES}]+", -1)).otherwise(F.array().cast("array<string>"))


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACES}]"))


def window_keys(words: Column, width: int = 3) -> Column:
    """One BIGINT for each window of ``width`` words, sorted: 32 bits of its hash, then its position."""
    key = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: (
        F.shiftleft(F.xxhash64(*[F.get(words, i + k) for k in range(width)]), 32) + i.cast("bigint")))
    return F.when(F.size(words) > width, F.sort_array(key)).otherwise(F.array().cast("array<bigint>"))


def repeated_words(words: Column, keys: Column, width: int = 3) -> Column:
    """Words lying in windows of ``width`` words that the text holds at least twice.

    Equal windows are neighbours in ``keys``. What shares no hash is dropped; windows that do are
    sorted by their words, which decides.
    """
    def hash_twin(key: Column, k: Column) -> Column:
        def same(other: Column) -> Column:
            return F.coalesce(F.shiftright(other, 32) == F.shiftright(key, 32), F.lit(False))
        return same(F.get(keys, k - 1)) | same(F.get(keys, k + 1))

    def spelled(key: Column) -> Column:
        at = key.bitwiseAND(F.lit(2**32 - 1)).cast("int")
        return F.struct(F.concat_ws(" ", *[F.get(words, at + k) for k in range(width)]).alias("window"), at.alias("at"))

    def covered(ordered: Column) -> Column:
        twins = F.filter(ordered, lambda item, k: (
            F.get(ordered, k - 1)["window"].eqNullSafe(item["window"])
            | F.get(ordered, k + 1)["window"].eqNullSafe(item["window"])))
        return F.array_distinct(F.flatten(F.transform(twins, lambda item: F.array(*[item["at"] + k for k in range(width)]))))

    suspects = F.sort_array(F.transform(F.filter(keys, hash_twin), spelled))
    return F.size(let(suspects, covered)).cast("bigint")


def characters(text: Column, of: str) -> Column:
    """How many characters of the class ``of`` a text has."""
    return F.regexp_count(text, F.lit(f"[{of}]")).cast("bigint")


def measured(df: DataFrame, text_col: str = "text", prefix: str = "",
             stop_words: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the measures of each text as columns ``prefix`` + measure; a NULL text has no words."""
    stops = list(stop_words) if stop_words is not None else sorted(set().union(*STOP_WORDS.values()))
    forms = [*stops, *(w.capitalize() for w in stops)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines = F.col(f"{prefix}__words"), F.col(f"{prefix}__lines")
    df = computed_once(df, **{f"{prefix}__words": words_of(text), f"{prefix}__lines": lines_of(text)})
    df = computed_once(df, **{f"{prefix}__keys": window_keys(words)})
    measures = {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(text) - characters(text, SPACES),
        "n_symbols": characters(text, "#*$%&|<>"),
        "n_marks": characters(text, "!?"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(forms))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": repeated_words(words, F.col(f"{prefix}__keys")),
    }
    out = computed_once(df, **{prefix + name: expr for name, expr in measures.items()})
    return out.drop(f"{prefix}__words", f"{prefix}__lines", f"{prefix}__keys")


def fails(rule: Rule, prefix: str = "") -> Column:
    left = F.col(prefix + rule.measure) * rule.scale
    right = F.col(prefix + rule.of) * rule.limit if rule.of else F.lit(rule.limit)
    return left < right if rule.beyond == "<" else left > right


def failed_any(rules: Sequence[Rule], prefix: str = "") -> Column:
    result = F.lit(False)
    for rule in rules:
        result = result | fails(rule, prefix)
    return result


def judged(df: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the measures, ``failed`` (names of the failed rules) and ``kept``.

    Every row of ``df`` stays, repeated ones too, with all its columns; ``prefix`` keeps the new names
    apart from existing ones. A text without words (NULL, empty, white space) fails ``few_words``.
    """
    names = [F.when(fails(rule, prefix), F.lit(rule.name)) for rule in rules]
    return measured(df, text_col, prefix).select(
        "*", F.filter(F.array(*names), lambda n: n.isNotNull()).alias(f"{prefix}failed"),
        (~failed_any(rules, prefix)).alias(f"{prefix}kept"))
