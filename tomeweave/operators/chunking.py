"""Splitting texts into chunks, numbering them and carrying chapter metadata."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.constants import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    LITERAL_SEPARATORS,
    SCENE_BREAK,
    SECTION_SEPARATORS,
    UNKNOWN,
)
from tomeweave.functions.chapters import detect_chapter
from tomeweave.functions.text import padded_id, slugify, strip
from tomeweave.scale import OrderBlocks, forward_fill, running_sums
from tomeweave.session import cut_lineage


# ---------------------------------------------------------------- fixed stride
def stride_starts(length: Column, size: int, overlap: int) -> Column:
    """1-based chunk starts; an empty text has none."""
    step = size - overlap
    return F.when(length > 0, F.sequence(F.lit(1), length, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def stride_count(length: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """How many chunks a text of that length has, without making them."""
    return F.ceil(length / (size - overlap)).cast("bigint")


def fixed_stride_chunks(
    docs: DataFrame,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk (``chunk_index`` from 0, ``chunk_text``); no shuffle."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    rest = [c for c in docs.columns if c != text]
    return docs.select(
        *rest, text, F.posexplode(stride_starts(F.length(text), size, overlap)).alias("chunk_index", "_start")
    ).select(*rest, "chunk_index", F.substring(F.col(text), F.col("_start"), F.lit(size)).alias("chunk_text"))


# ------------------------------------------------------------ recursive splits
def separators_for(universe: str = "") -> list[str]:
    """Regular expressions in the order they are tried; literal ones are escaped."""
    literal = [re.escape(s) for s in LITERAL_SEPARATORS]
    series = SECTION_SEPARATORS.get(universe.lower(), [])
    if universe.lower() == "wheel of time":
        series = [*series, re.escape(SCENE_BREAK)]
    return [*series, *literal]


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of a text, each but the first beginning with the separator it followed."""
    if not separator:
        return list(text)
    at = [m.start() for m in re.finditer(separator, text) if m.end() > m.start()]
    edges = [0, *at, len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:]) if b > a]


def _merge(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to ``size``, repeating a tail of at most ``overlap``."""
    held: list[str] = []
    first = 0
    total = 0
    for piece in pieces:
        if total + len(piece) > size and first < len(held):
            yield "".join(held[first:])
            while first < len(held) and (total > overlap or total + len(piece) > size):
                total -= len(held[first])
                first += 1
        held.append(piece)
        total += len(piece)
    if first < len(held):
        yield "".join(held[first:])


def split_text(text: str, separators: Sequence[str], size: int, overlap: int) -> list[str]:
    """Recursive splitting of one text: the first separator that occurs, then the rest for long pieces."""
    level = next((i for i, s in enumerate(separators) if not s or re.search(s, text)), len(separators) - 1)
    deeper = separators[level + 1 :]
    out: list[str] = []
    short: list[str] = []

    def settle() -> None:
        out.extend(c for c in (m.strip() for m in _merge(short, size, overlap)) if c)
        short.clear()

    for piece in _cut(text, separators[level]):
        if len(piece) < size or not deeper:
            short.append(piece)
        else:
            settle()
            out.extend(split_text(piece, deeper, size, overlap))
    settle()
    return out


def recursive_chunks(
    docs: DataFrame,
    text: str = "text",
    universe: str = "",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """``chunk_index``/``chunk_text`` rows for each document.

    Only ``text`` crosses to Python, one Arrow batch at a time; the other columns
    stay in the JVM and the split comes back as an array that is exploded there.
    """
    seps = separators_for(universe)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, seps, size, overlap) if t else [])

    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(split(F.col(text))).alias("chunk_index", "chunk_text"))


# ----------------------------------------------------- numbering and chapters
def first_positions(
    counts: DataFrame, group: Sequence[str], document: str, blocks: OrderBlocks | None = None
) -> DataFrame:
    """(group, document, ``first_position``): where each document's chunks start in scan order.

    ``counts`` has one narrow row per document with its chunk count ``n_chunks``;
    no chunk text is sorted or moved to number the chunks.
    """
    ends = running_sums(counts, group, [document], {"_end": F.col("n_chunks")}, blocks)
    return ends.select(*group, document, (F.col("_end") - F.col("n_chunks")).alias("first_position"))


def chunk_name(series: Column, position: Column) -> Column:
    """``{series}_rag_{position:05d}``"""
    return padded_id("%s_rag_%05d", slugify(series), position)


def stride_rag_chunks(
    docs: DataFrame,
    series: str,
    document: str,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    blocks: OrderBlocks | None = None,
) -> DataFrame:
    """Numbered fixed-stride chunks per series; whole documents are numbered before they are cut."""
    counts = docs.select(series, document, stride_count(F.length(text), size, overlap).alias("n_chunks"))
    starts = first_positions(counts, [series], document, blocks)
    placed = docs.join(starts, [series, document])
    return fixed_stride_chunks(placed, text, size, overlap).withColumn(
        "chunk_id", chunk_name(F.col(series), F.col("first_position") + F.col("chunk_index"))
    ).drop("first_position")


def fill_chapters(
    chunks: DataFrame,
    found: Column,
    group: Sequence[str],
    order: Sequence[str],
    blocks: OrderBlocks | None = None,
    **options: int,
) -> DataFrame:
    """Add ``chapter_number``/``chapter_title`` of the last header at or before each chunk.

    ``found`` is a struct(number, title) column, null where a chunk has no header.
    The struct is carried as a whole and never crosses into another ``group``.
    """
    filled = forward_fill(chunks, group, order, found, "_chapter", blocks, **options)
    return filled.withColumns(
        {
            "chapter_number": F.coalesce(F.col("_chapter.number"), F.lit(UNKNOWN)),
            "chapter_title": F.coalesce(F.col("_chapter.title"), F.lit(UNKNOWN)),
        }
    ).drop("_chapter")


def rag_chunks(books: DataFrame, universe: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Books (``book_order``, ``book_name``, ``text``) as the rows of the chunk table."""
    # Numbering and filling both look at the chunks: split once, read them back.
    split = cut_lineage(recursive_chunks(books, "text", universe, size, overlap), "chunks")
    found = detect_chapter(F.col("chunk_text"), universe)
    # The block key is the chunk position: a single huge book is cut into blocks too.
    filled = fill_chapters(split, found, ["book_order", "book_name"], ["chunk_index"])
    counts = split.groupBy("book_order").agg((F.max("chunk_index") + 1).cast("bigint").alias("n_chunks"))
    numbered = filled.join(first_positions(counts, [], "book_order"), "book_order").withColumn(
        "chunk_id", chunk_name(F.lit(universe), F.col("first_position") + F.col("chunk_index"))
    )
    return numbered.select(
        "chunk_id",
        slugify(F.lit(universe)).alias("series"),
        F.col("chunk_text").alias("text_content"),
        F.length("chunk_text").cast("bigint").alias("character_count"),
        F.struct(
            "book_name", "chapter_number", "chapter_title", F.lit(universe).alias("universe")
        ).alias("metadata"),
        F.current_timestamp().alias("created_at"),
    )


def paragraphs(docs: DataFrame, text: str = "text", separator: str = "\n") -> DataFrame:
    """Non-empty stripped parts of each text with their position before filtering."""
    rest = [c for c in docs.columns if c != text]
    return (
        docs.select(*rest, F.posexplode(F.split(F.col(text), separator)).alias("part_index", "_part"))
        .select(*rest, "part_index", strip(F.col("_part")).alias("part"))
        .where(F.length("part") > 0)
    )
