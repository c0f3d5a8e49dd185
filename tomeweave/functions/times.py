"""The three ways a time is written, and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_iso(text: Column) -> Column:
    """ISO-8601 text with an offset; null when it is none."""
    return F.try_to_timestamp(text)


def to_iso(time: Column) -> Column:
    """ISO-8601 text in UTC with microseconds."""
    return F.concat(F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_epoch(time: Column) -> Column:
    return F.unix_micros(time) / 1e6


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6
