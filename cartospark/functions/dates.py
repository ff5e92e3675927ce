"""Dates as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str | None = None) -> Column:
    """A timestamp, null where the text doesn't fit; times of a zone are brought to UTC."""
    t = F.try_to_timestamp(text, F.lit(pattern))
    return F.to_utc_timestamp(t, zone) if zone else t


def format_time(t, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(t, pattern)


def to_utc(t, zone: str) -> Column:
    return F.to_utc_timestamp(t, zone)
