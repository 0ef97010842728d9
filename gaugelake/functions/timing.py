"""Event-time resolution and time literals."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugelake.functions import variants as V

# Accepted besides ISO 8601, tried in this order; the month comes before the day.
TIME_FORMATS = (
    "yyyy/M/d[ H:mm[:ss[.SSSSSSSSS]]]",
    "yyyyMMdd['T'HHmm[ss]]",
    "yyyyMMdd[ HH:mm[:ss]]",
    "M/d/yyyy[ H:mm[:ss[.SSSSSSSSS]]]",
    "M/d/yyyy h:mm[:ss] a",
    "yyyy-MM-dd h:mm[:ss] a",
    "MMM d, yyyy[ H:mm[:ss]]",
    "MMMM d, yyyy[ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss]]",
)
# Day names in front and marks of UTC behind say nothing more.
_DAY_NAME, _UTC_MARK = r"^[A-Z][a-z]{2}, ", r"( ?(GMT|UTC)|Z)$"

_MICROS_PER = {"s": 1_000_000.0, "ms": 1_000.0, "us": 1.0, "ns": 0.001}


def instant(at: datetime | date, kind: str = "timestamp") -> Column:
    """A time literal; without an offset it means UTC, whatever time zone this process runs in."""
    if isinstance(at, datetime) and at.tzinfo is not None:
        at = at.astimezone(timezone.utc).replace(tzinfo=None)
    # plain lit(datetime) would be read as local time
    literal = F.lit(at.isoformat()).cast("timestamp_ntz")
    return literal if kind == "timestamp_ntz" else literal.cast(kind)


def parse_time_text(text: Column, bucket_clock: str = "utc") -> Column:
    """Text -> TIMESTAMP, NULL when unreadable.

    ``bucket_clock="source"`` keeps the wall clock written in the text and ignores its offset;
    ``"utc"`` converts the instant.
    """
    if bucket_clock == "source":
        iso = text.try_cast("timestamp_ntz").cast("timestamp")
    elif bucket_clock == "utc":
        iso = text.try_cast("timestamp")
    else:
        raise ValueError(f"bucket_clock must be utc or source, not {bucket_clock!r}")
    plain = F.regexp_replace(F.regexp_replace(text, _DAY_NAME, ""), _UTC_MARK, "")
    return F.coalesce(iso, *[F.try_to_timestamp(plain, F.lit(f)) for f in TIME_FORMATS])


def payload_time(value: Column, kind: Column, bucket_clock: str = "utc", numeric_unit: str = "ms") -> Column:
    """VARIANT text or number -> TIMESTAMP; NULL for anything else."""
    micros = (value.try_cast("double") * F.lit(_MICROS_PER[numeric_unit])).try_cast("bigint")
    return (
        F.when(kind == "STRING", parse_time_text(F.trim(V.as_text(value)), bucket_clock))
        .when(V.is_numeric(kind), F.timestamp_micros(micros))
    )
