"""Union of drifting schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _widest(a: T.DataType, b: T.DataType) -> T.DataType:
    """Common type of a column: integers and floats meet in DOUBLE, anything else in STRING."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if isinstance(a, times) and isinstance(b, times):
        return T.TimestampType()
    return T.StringType()


def union_by_name(*parts: DataFrame) -> DataFrame:
    """Append by column name: missing columns become NULL, differing types are widened."""
    common: dict[str, T.DataType] = {}
    for part in parts:
        for f in part.schema.fields:
            common[f.name] = _widest(common[f.name], f.dataType) if f.name in common else f.dataType
    cast = [
        p.select(*[F.col(f.name).cast(common[f.name]).alias(f.name) for f in p.schema.fields])
        for p in parts
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)
