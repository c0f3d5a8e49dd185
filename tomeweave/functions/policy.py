"""Error classes, retry delays and other small rules around model calls, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeweave.constants import (
    EMBED_BACKOFF_SECONDS,
    RATE_LIMIT_FLOOR_SECONDS,
    RATE_LIMIT_MARKS,
    TRANSIENT_MARKS,
)


def _mentions(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(m) for m in marks])


def error_class(message: Column) -> Column:
    return (
        F.when(_mentions(message, RATE_LIMIT_MARKS), "rate_limit")
        .when(_mentions(message, TRANSIENT_MARKS), "transient")
        .otherwise("other")
    )


def backoff_seconds(
    kind: Column, attempt: Column, base: float = EMBED_BACKOFF_SECONDS, least: float = 0.0, most: float | None = None, floor: float = RATE_LIMIT_FLOOR_SECONDS
) -> Column:
    """Doubling delay between ``least`` and ``most``; never below ``floor`` after a rate limit."""
    delay = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    delay = F.greatest(F.lit(least), delay if most is None else F.least(F.lit(most), delay))
    return F.when(kind == "rate_limit", F.greatest(delay, F.lit(floor))).otherwise(delay)


def safe_limit(window: int, margin: float) -> int:
    """Token budget left after the safety margin."""
    return int(window * (1 - margin))
