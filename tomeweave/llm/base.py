"""Small helpers that the training-data operators share."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.scale import BROADCAST_ROWS, broadcast_counted, rows_named  # noqa: F401 - the operators import them from here
from tomeweave.session import ship_package


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Run ``work`` on every Arrow batch of ``df`` (at most 64 MB each by Spark's default)."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a UTF-8 column without copying; a null has no bytes."""
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends, raw


def pieces(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes (one row at least)."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


# ------------------------------------------------------- matches inside a text
STRIDE = 256


def sums_before(lengths: Column, upto: Column) -> Column:
    """Sum of the first ``upto`` numbers of an array, with sums of whole strides taken first.

    ``lengths`` is a struct column (each, strides) from ``with_strides``.
    """
    add = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x)
    whole = F.floor(upto / STRIDE).cast("int")
    return add(F.slice(lengths["strides"], F.lit(1), whole)) + add(
        F.slice(lengths["each"], whole * STRIDE + 1, upto - whole * STRIDE)
    )


def with_strides(each: Column) -> Column:
    add = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(each)), F.lit(STRIDE))
    return F.struct(each.alias("each"), F.transform(starts, lambda s: add(F.slice(each, s, STRIDE))).alias("strides"))


def with_matches(df: DataFrame, text: str, pattern: str | Column, name: str, possible: Column | None = None) -> DataFrame:
    """Add ``<name>_gaps``, ``<name>_hits`` and ``<name>_starts``: all leftmost, non-overlapping matches of a pattern.

    Splitting by a pattern and extracting it see the same matches, so the hit k
    starts after the gaps up to k and the hits before it. Starts are 0-based code
    points. Texts for which ``possible`` is not true are not searched.
    """
    ok = F.coalesce(possible, F.lit(False)) if possible is not None else F.lit(True)
    none = F.array().cast("array<string>")
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps, hits, sums, starts = (f"{name}_{x}" for x in ("gaps", "hits", "sums", "starts"))
    df = df.withColumns({
        hits: F.when(ok, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none),
    })
    df = df.withColumns({
        gaps: F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.array(F.col(text))),
    })
    both = F.zip_with(
        F.transform(gaps, lambda g: F.char_length(g)), F.transform(hits, lambda h: F.char_length(h)),
        lambda g, h: g + F.coalesce(h, F.lit(0)),
    )
    df = df.withColumn(f"{name}_each", F.when(F.size(hits) > 0, both))
    df = df.withColumn(sums, F.when(F.size(hits) > 0, with_strides(F.col(f"{name}_each"))))
    at = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(hits) - 1)),
        lambda k: sums_before(F.col(sums), k) + F.char_length(F.get(gaps, k)),
    )
    return df.withColumn(starts, F.when(F.size(hits) > 0, at).otherwise(F.array().cast("array<int>"))).drop(f"{name}_each", sums)
