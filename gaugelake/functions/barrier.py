"""Computing expensive columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections refer to instead of repeating.

    Catalyst pushes filters below projections and copies the projected expressions into them; with
    parsed JSON every copy parses again. It does not push through a generator on its outputs, so
    the columns pass through one that yields a single row. Filters on other columns still move past.
    """
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(row)))
