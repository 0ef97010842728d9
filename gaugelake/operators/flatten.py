"""Payload flattening: declared wide columns, or maps of measures and attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.constants import CANONICAL_KEYS, NON_MEASURES
from gaugelake.functions import variants as V
from gaugelake.functions.barrier import computed_once

FIXED_COLUMNS = (
    "sensor_name", "table_name", "asset_id", "event_time", "time_quality", "topic", "partition",
    "offset", "kafka_timestamp", "ingest_ts", "arrival_order",
)


def flatten_wide(
    rows: DataFrame,
    measures: Mapping[str, Sequence[str]],
    attributes: Mapping[str, Sequence[str]] | None = None,
    on_collision: str = "envelope",
) -> DataFrame:
    """Fixed columns plus one column per declared payload field.

    ``measures`` / ``attributes`` map a column name to its path, for example
    ``{"value": ["value"], "props_k": ["props", "k"]}``. Measures become DOUBLE and are NULL unless
    the JSON value is a number; attributes become STRING. A payload that is no object counts as
    its own ``value``.

    A payload column named like a fixed one is kept as ``payload_<name>``
    (``on_collision="envelope"``) or replaces it (``"payload"``) where the payload has it.
    """
    if on_collision not in ("envelope", "payload"):
        raise ValueError(f"on_collision must be envelope or payload, not {on_collision!r}")
    paths = {**measures, **(attributes or {})}
    data = F.col("data")
    at_value = F.when(F.col("_data_kind").startswith("OBJECT"), V.field(data, "value")).otherwise(data)
    raw = {name: f"_raw{i}" for i, name in enumerate(paths)}
    found = rows.withColumn("_data_kind", V.kind(data)).select("*", *[
        (at_value if list(path) == ["value"] else V.field(data, *path)).alias(raw[name])
        for name, path in paths.items()
    ])
    kinds = found.select("*", *[V.kind(F.col(raw[m])).alias(f"{raw[m]}_kind") for m in measures])
    flat = computed_once(kinds, **{
        f"{raw[name]}_out": V.as_measure(F.col(raw[name]), F.col(f"{raw[name]}_kind"))
        if name in measures else V.as_text(F.col(raw[name]))
        for name in paths
    })

    columns: dict[str, Column] = {c: F.col(c) for c in FIXED_COLUMNS if c in rows.columns}
    for name in paths:
        out = F.col(f"{raw[name]}_out")
        if name not in columns:
            columns[name] = out
        elif on_collision == "envelope":
            columns[f"payload_{name}"] = out
        else:
            columns[name] = F.coalesce(out.try_cast(rows.schema[name].dataType), columns[name])
    return flat.select(*[expr.alias(name) for name, expr in columns.items()])


def _with_entries(rows: DataFrame) -> DataFrame:
    """Add ``_entries``: the payload as array of (key, value), objects one level down as ``{key}_{subkey}``.

    Names are unique: of equal ones the last in key order keeps the name, as in a payload written in that
    order; those before it are kept as ``{name}__2``, ``{name}__3`` and so on.
    """
    top = computed_once(rows, _top=F.map_entries(F.col("data").try_cast("map<string,variant>")))

    def opened(e: Column) -> Column:
        parts = F.transform(
            F.map_entries(e["value"].try_cast("map<string,variant>")),
            lambda s: _pair(F.concat(e["key"], F.lit("_"), s["key"]), s["value"]),
        )
        single = F.array(_pair(e["key"], e["value"]))
        # only objects can be cast to a map
        return F.when(e["key"].isin(*CANONICAL_KEYS), single).otherwise(F.coalesce(parts, single))

    single = F.array(_pair(F.lit("value"), F.col("data")))
    entries = computed_once(top, _all=F.coalesce(F.flatten(F.transform("_top", opened)), single))
    named = entries.withColumn("_names", F.transform("_all", lambda e: e["key"]))
    # names that occur once, as most do, are not compared with each other
    apart = F.size(F.array_distinct("_names")) == F.size("_names")

    def renamed(e: Column, i: Column) -> Column:
        later = F.size(F.filter("_names", lambda n, j: (j > i) & (n == e["key"])))
        return _pair(F.when(later == 0, e["key"]).otherwise(F.concat(e["key"], F.lit("__"), (later + 1).cast("string"))), e["value"])

    unique = F.when(apart, F.col("_all")).otherwise(F.transform("_all", renamed))
    return computed_once(named, _entries=unique).drop("_top", "_all", "_names")


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _is_measure(e: Column) -> Column:
    return F.coalesce(V.is_numeric(V.kind(e["value"])), F.lit(False)) & ~e["key"].isin(*NON_MEASURES)


def flatten_maps(rows: DataFrame, include_kafka_timestamp: bool = False) -> DataFrame:
    """Fixed columns plus ``measures MAP<STRING,DOUBLE>`` and ``attrs MAP<STRING,STRING>``.

    Numbers are measures, also a numeric ``time`` or ``daqid``; everything else is an attribute,
    nested values as JSON text.
    """
    measures = F.transform(
        F.filter("_entries", _is_measure), lambda e: _pair(e["key"], e["value"].try_cast("double"))
    )
    if include_kafka_timestamp:
        extra = F.array(_pair(F.lit("kafka_timestamp"), F.col("kafka_timestamp").cast("double")))
        measures = F.concat(
            F.filter(measures, lambda e: e["key"] != "kafka_timestamp"),
            F.when(F.col("kafka_timestamp").isNotNull(), extra).otherwise(F.slice(extra, 1, 0)),
        )
    attrs = F.transform(
        F.filter("_entries", lambda e: ~_is_measure(e)), lambda e: _pair(e["key"], V.as_text(e["value"]))
    )
    fixed = [c for c in FIXED_COLUMNS if c in rows.columns]
    return _with_entries(rows).select(
        *fixed, F.map_from_entries(measures).alias("measures"), F.map_from_entries(attrs).alias("attrs")
    )


def explode_measures(flat: DataFrame) -> DataFrame:
    """One row per (message, measure); messages without measures drop out."""
    fixed = [c for c in FIXED_COLUMNS if c in flat.columns]
    return flat.select(*fixed, F.explode("measures").alias("measure", "value"))


def discover_fields(rows: DataFrame) -> DataFrame:
    """Every flattened payload field with its JSON types and row count, in one pass."""
    entries = _with_entries(rows).select(F.explode("_entries").alias("e"))
    kinds = entries.select(
        F.col("e.key").alias("field"),
        F.regexp_extract(V.kind(F.col("e.value")), "^[A-Z]+", 0).alias("type"),
    )
    return kinds.groupBy("field", "type").agg(F.count("*").alias("rows"))


def wide_from_maps(flat: DataFrame, measures: Sequence[str], attributes: Sequence[str] = ()) -> DataFrame:
    """Chosen map keys as columns."""
    taken = [flat["measures"][m].alias(m) for m in measures]
    taken += [flat["attrs"][a].alias(a) for a in attributes]
    fixed = [c for c in flat.columns if c not in ("measures", "attrs")]
    return flat.select(*fixed, *taken)
