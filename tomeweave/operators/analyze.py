"""Corpus and dataset statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.constants import UNKNOWN
from tomeweave.functions.text import preview


def flatten_documents(docs: DataFrame, text: str = "page_content", metadata: str = "metadata") -> DataFrame:
    """(text, length, every metadata field)."""
    return docs.select(
        F.col(text).alias("text"), F.length(text).cast("bigint").alias("length"), f"{metadata}.*"
    )


def summary(chunks: DataFrame, length: Column, number: str = "chapter_number", title: str = "chapter_title") -> DataFrame:
    """One row: chunk count, mean/max/min size, chunks with unknown chapter and their share."""
    unknown = (F.col(number) == UNKNOWN) & (F.col(title) == UNKNOWN)
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        F.round(F.avg(length), 6).alias("avg_size"),
        F.max(length).cast("bigint").alias("max_size"),
        F.min(length).cast("bigint").alias("min_size"),
        F.count_if(unknown).alias("na_chapters"),
        F.round(F.count_if(unknown) * 100.0 / F.count("*"), 1).alias("na_percentage"),
    )


def book_distribution(chunks: DataFrame, book: str, number: str, title: str) -> DataFrame:
    """Chunks and distinct (number, title) pairs per book, the largest book first.

    Counted in two levels, first per (book, number, title), so a book that holds a
    third of all chunks is spread over the reducers of the first level.
    """
    pairs = chunks.where(F.col(book).isNotNull()).groupBy(book, number, title).agg(F.count("*").alias("_n"))
    return (
        pairs.groupBy(book)
        .agg(F.sum("_n").alias("chunks"), F.count("*").alias("unique_chapters"))
        .orderBy(F.desc("chunks"), book)
    )


def sample_chunks(chunks: DataFrame, order: Sequence[str], text: str, n: int = 3) -> DataFrame:
    """The first ``n`` chunks with a one-line preview."""
    return chunks.orderBy(*order).limit(n).select(*order, preview(F.col(text)).alias("content_preview"))


def value_counts(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, value, n) for several dimensions in one pass; null is a value of its own.

    Rows become one (dimension, value) pair each and are counted with a map-side partial.
    """
    columns = {f"_d{i}": c.cast("string") for i, c in enumerate(dimensions.values())}
    names = list(dimensions)
    stacked = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("value")) for n, c in zip(names, columns.values())])
        ).alias("_v")
    ).select("_v.*")
    return stacked.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def distinct_member_counts(df: DataFrame, group: Sequence[str], array: Column, name: str) -> DataFrame:
    """Distinct array members per group, counted in two levels and never collected."""
    members = df.select(*group, F.explode(array).alias("_m")).distinct()
    return members.groupBy(*group).agg(F.count("_m").alias(name))


def size_histogram(df: DataFrame, size: Column, name: str = "size") -> DataFrame:
    return df.groupBy(size.cast("bigint").alias(name)).agg(F.count("*").alias("n")).orderBy(name)


def export(df: DataFrame, path: str) -> None:
    """Write as JSON, CSV or Parquet by the suffix of ``path``; other suffixes mean JSON."""
    kind = path.rsplit(".", 1)[-1].lower()
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        writer.json(path)
