"""Embedding only what is new: cache join, resume by anti-join, vector rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.functions.text import content_hash, slugify
from tomeweave.models.boundary import Embedder, Retry
from tomeweave.models.udfs import embed_column
from tomeweave.scale import broadcast_if_small, row_index


def with_cache(texts: DataFrame, cache: DataFrame, text: str, model: str | None = None) -> DataFrame:
    """Add ``text_hash`` and the cached ``embedding`` (null on a miss).

    The cache has one row per hash. Copies of a text make its hash a hot key on
    the left side only, which adaptive execution splits across tasks.
    """
    known = cache if model is None else cache.where(F.col("model") == model)
    return texts.withColumn("text_hash", content_hash(F.col(text))).join(
        known.select("text_hash", "embedding"), "text_hash", "left"
    )


def cache_misses(texts: DataFrame, cache: DataFrame, text: str, model: str | None = None) -> DataFrame:
    """(text_hash, text): each unknown text once, however many copies it has.

    Hashes are reduced with a map-side partial before they meet the cache.
    """
    hashed = texts.select(content_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    known = cache if model is None else cache.where(F.col("model") == model)
    return hashed.groupBy("text_hash").agg(F.first("text").alias("text")).join(
        known.select("text_hash"), "text_hash", "left_anti"
    )


def cache_rows(misses: DataFrame, model: Embedder, retry: Retry | None = None) -> DataFrame:
    """Embed misses into cache rows; failed texts are left out and come again next run."""
    called = misses.withColumn("_e", embed_column(F.col("text"), model, retry))
    return called.where(F.col("_e.error").isNull()).select(
        "text_hash",
        F.lit(model.name).alias("model"),
        F.col("_e.embedding").alias("embedding"),
        F.struct(F.length("text").cast("bigint").alias("text_length")).alias("metadata"),
    )


def pending(items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items without a finished counterpart; the output table is the checkpoint."""
    return items.join(broadcast_if_small(done.select(*keys)), list(keys), "left_anti")


def embed_chunks(chunks: DataFrame, model: Embedder, retry: Retry | None = None) -> DataFrame:
    """Rows of the chunk table as rows of the embeddings table."""
    called = chunks.withColumn("_e", embed_column(F.col("text_content"), model, retry))
    meta = lambda name: F.coalesce(F.col(f"metadata.{name}"), F.lit(""))
    return called.where(F.col("_e.error").isNull()).select(
        "chunk_id",
        "series",
        "text_content",
        F.coalesce("character_count", F.length("text_content").cast("bigint")).alias("character_count"),
        meta("book_name").alias("book_name"),
        meta("chapter_number").alias("chapter_number"),
        meta("chapter_title").alias("chapter_title"),
        meta("universe").alias("universe"),
        F.col("_e.embedding").alias("embedding"),
        F.lit(model.name).alias("embedding_model"),
        F.size("_e.embedding").alias("embedding_dim"),
        F.current_timestamp().alias("embedded_at"),
    )


def embed_pending(chunks: DataFrame, path: str, model: Embedder, retry: Retry | None = None) -> None:
    """Embed the chunks a Parquet folder does not hold yet and append them to it.

    A lost run leaves either all or none of its files. Chunks whose call failed
    are not in the folder, so the next run takes them up.
    """
    spark = chunks.sparkSession
    from tomeweave.schemas import struct_of

    try:
        done = spark.read.schema(struct_of("embeddings")).parquet(path)
        todo = pending(chunks, done, ["chunk_id"])
    except Exception as error:  # the folder is not there before the first run
        if "PATH_NOT_FOUND" not in str(error):
            raise
        todo = chunks
    embed_chunks(todo, model, retry).write.mode("append").parquet(path)


def zip_rows(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The n-th row of one table beside the n-th row of the other; both must have the same length to lose nothing."""
    numbered = row_index(left, [], left_order, "_at"), row_index(right, [], right_order, "_at")
    return numbered[0].join(numbered[1], "_at").drop("_at")


def zip_all(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], position: str = "position") -> DataFrame:
    """The same with the tail of the longer table: ``position`` and a ``status`` of ``both``, ``left`` or ``right``."""
    numbered = [row_index(df, [], order, position).withColumn(mark, F.lit(True)) for df, order, mark in ((left, left_order, "_l"), (right, right_order, "_r"))]
    status = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return numbered[0].join(numbered[1], position, "full_outer").withColumn("status", status).drop("_l", "_r")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def vector_rows(embedded: DataFrame, max_text: int | None = None) -> DataFrame:
    """Rows of the vector collection: renamed and defaulted to "".

    Texts stay whole; ``max_text`` cuts them for a store whose column has a width.
    """
    require_columns(embedded, ["chunk_id", "embedding", "text_content"])
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    return embedded.select(
        "embedding",
        (text("text_content") if max_text is None else F.left(text("text_content"), F.lit(max_text))).alias("text"),
        text("chunk_id").alias("chunk_id"),
        text("series").alias("series"),
        text("universe").alias("universe"),
        text("book_name").alias("book_title"),
        text("chapter_number").alias("chapter_number"),
        text("chapter_title").alias("chapter_title"),
    )


def cache_name(universe: Column, model: Column) -> Column:
    """Name of a series' cache: slug of the universe and a model name safe in a path."""
    return F.concat_ws("_", slugify(universe), F.translate(model, "/-", "__"))
