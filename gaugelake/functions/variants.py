"""Column expressions over VARIANT payload values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Appended as a second array element when parsing, so that trailing garbage cannot go unnoticed.
_END = "~end~"


def parse_json_strict(text: Column) -> Column:
    """JSON text -> two-element VARIANT array ``[document, end mark]``, NULL when it is no JSON.

    ``try_parse_json`` stops after the first complete value, so ``12 abc`` would parse as 12;
    inside an array the rest of the text must parse too. NaN and Infinity are accepted.
    """
    wrapped = F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))
    lenient = F.from_json(wrapped, "variant", {"allowSingleQuotes": "false"})
    return F.coalesce(
        F.try_parse_json(wrapped),
        F.when(text.contains("NaN") | text.contains("Infinity"), lenient),
    )


def is_document(parsed: Column) -> Column:
    return F.coalesce(F.try_variant_get(parsed, "$[1]", "string") == _END, F.lit(False))


def document(parsed: Column) -> Column:
    return F.try_variant_get(parsed, "$[0]", "variant")


def field(data: Column, *names: str) -> Column:
    """``data[name1][name2]…`` as VARIANT; NULL when absent or when ``data`` is no object."""
    path = "$" + "".join(f'["{name}"]' for name in names)
    return F.try_variant_get(data, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_numeric(kind: Column) -> Column:
    """True for JSON numbers only: neither booleans nor numbers in quotes."""
    return kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT") | kind.startswith("DECIMAL")


def is_object(kind: Column) -> Column:
    return kind.startswith("OBJECT")


def as_measure(value: Column, kind: Column) -> Column:
    return F.when(is_numeric(kind), value.try_cast("double"))


def as_text(value: Column) -> Column:
    """Scalars as plain text, objects and arrays as JSON text."""
    return value.try_cast("string")


def as_written(value: Column, kind: Column) -> Column:
    """Like ``as_text``; a number written with a fraction keeps one (1.0, not 1).

    Whole numbers of up to 18 digits are BIGINT, so a DECIMAL of that size without places had some.
    """
    return F.concat(as_text(value), F.when(kind.rlike(r"^DECIMAL\((\d|1[0-8]),0\)$"), F.lit(".0")).otherwise(F.lit("")))


def is_truthy(value: Column, kind: Column) -> Column:
    """Whether a payload value counts as given: not null, "", 0, false, [] or {}."""
    return F.coalesce(
        F.when(is_numeric(kind), value.try_cast("double") != 0)
        .when(kind == "BOOLEAN", value.try_cast("boolean"))
        .when(kind == "VOID", F.lit(False))
        .when(kind.startswith("ARRAY"), as_text(value) != "[]")
        .when(kind.startswith("OBJECT"), as_text(value) != "{}")
        .otherwise(as_text(value) != ""),
        F.lit(False),
    )
