"""Times in tests."""

from datetime import datetime, timezone


def utc(*parts) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)
