"""Question-answer datasets: batches, resume, validation, storage rows, audit, statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.constants import (
    ABORT_AFTER,
    AUDIT_BLOCK,
    CATEGORIES,
    CATEGORY_BLOCK,
    COMPLEXITIES,
    EVAL_BATCH,
    EVALUATION_BLOCK,
    MISSING_SOURCES,
    NO_SOURCES,
    QA_BATCH,
    QA_OVERLAP,
    UNNAMED,
)
from tomeweave.functions.text import filled, or_default, padded_id, word_count
from tomeweave.operators.tables import sample_by_hash
from tomeweave.scale import (
    ROWS_PER_BLOCK,
    OrderBlocks,
    broadcast_if_small,
    collect_bounded,
    row_index,
    running_sums,
)


# --------------------------------------------------------------------- batches
def tumbling_members(
    chunks: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    size: int = EVAL_BATCH,
    start_batch: int = 0,
    max_batches: int | None = None,
    blocks: OrderBlocks | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``row_index`` and ``batch_index``; only the asked-for run of batches is kept."""
    rows = row_index(chunks, group, order, "row_index", blocks, rows_per_block)
    rows = rows.withColumn("batch_index", F.floor(F.col("row_index") / size).cast("bigint"))
    if start_batch:
        rows = rows.where(F.col("batch_index") >= start_batch)
    if max_batches is not None:
        rows = rows.where(F.col("batch_index") < start_batch + max_batches)
    return rows


def overlapping_members(
    chunks: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    size: int = QA_BATCH,
    overlap: int = QA_OVERLAP,
    blocks: OrderBlocks | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """One row per (chunk, batch it belongs to); batches start every ``size - overlap`` chunks.

    A chunk works out its batches from its own position, so no range join is
    needed, and short tail batches stay even when the previous one covers them.
    """
    step = size - overlap if size > overlap else size
    rows = row_index(chunks, group, order, "row_index", blocks, rows_per_block)
    at = F.col("row_index")
    first = F.greatest(F.lit(0), F.ceil((at - size + 1) / step)).cast("bigint")
    last = F.floor(at / step).cast("bigint")
    return rows.withColumn("batch_index", F.explode(F.sequence(first, last)))


def describe_batches(
    members: DataFrame, group: Sequence[str], chunk_id: str, book: Column, tokens: Column, characters: Column
) -> DataFrame:
    """One row per batch: id, size, books and token estimates. A batch has a fixed number of members.

    It needs counts, not texts: measure the chunks (see ``measured``) before they
    are put into batches, and no text is shuffled.
    """
    at = F.col("row_index")
    return (
        members.groupBy(*group, "batch_index")
        .agg(
            F.min_by(F.col(chunk_id), at).alias("first_chunk"),
            F.max_by(F.col(chunk_id), at).alias("last_chunk"),
            F.count("*").alias("n_chunks"),
            F.array_sort(F.collect_set(F.nullif(book, F.lit("")))).alias("included_books"),
            F.sum(tokens).alias("token_count"),
            F.floor(F.sum(characters) / 4).cast("bigint").alias("estimated_tokens"),
        )
        .withColumn(
            "batch_id",
            F.concat(F.col("first_chunk").cast("string"), F.lit("_to_"), F.col("last_chunk").cast("string")),
        )
    )


def measured(chunks: DataFrame, text: str, token_count: str | None = None) -> DataFrame:
    """Replace the text by ``n_tokens`` (the stored count, else its words) and ``n_characters``."""
    words = word_count(F.col(text))
    tokens = F.coalesce(F.col(token_count).cast("bigint"), words) if token_count else words
    return chunks.withColumns({"n_tokens": tokens, "n_characters": F.length(text).cast("bigint")}).drop(text)


def batch_text(members: DataFrame, group: Sequence[str], chunk_id: str, text: str, style: str = "category", book: Column | None = None, chapter: Column | None = None) -> DataFrame:
    """The ordered text of each batch with a header per chunk, as the prompt builders need it."""
    cid = F.col(chunk_id).cast("string")
    named = lambda c: F.lit(UNNAMED) if c is None else F.coalesce(c, F.lit(UNNAMED))
    if style == "category":
        block, glue = filled(CATEGORY_BLOCK, id=cid, text=F.col(text)), ""
    else:
        block = filled(EVALUATION_BLOCK, id=cid, book=named(book), chapter=named(chapter), text=F.col(text))
        glue = "\n"
    parts = members.groupBy(*group, "batch_index").agg(
        F.array_sort(F.collect_list(F.struct("row_index", cid.alias("cid"), block.alias("block")))).alias("_p")
    )
    return parts.select(
        *group,
        "batch_index",
        F.array_join(F.transform("_p", lambda p: p["cid"]), ", ").alias("chunk_ids"),
        F.array_join(F.transform("_p", lambda p: p["block"]), glue).alias("batch_text"),
    )


def processed_batches(qa: DataFrame, equal: Mapping[str, object], batch_id: str) -> DataFrame:
    """Distinct batch ids of the stored pairs that meet the equalities."""
    rows = qa
    for name, value in equal.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.select(F.col(batch_id).alias("batch_id")).where(F.col("batch_id").isNotNull()).distinct()


def pending_batches(batches: DataFrame, processed: DataFrame, on: Sequence[str] = ("batch_id",)) -> DataFrame:
    return batches.join(processed, list(on), "left_anti")


# ------------------------------------------------------------------ validation
def validate_source_ids(qa: DataFrame, members: DataFrame, qa_key: Sequence[str], batch: Sequence[str], source_ids: str, chunk_id: str) -> DataFrame:
    """Keep of each pair only the ids that were in its batch, in their order; drop pairs left with none.

    ``members`` lists (batch..., chunk id) rows. Ids are exploded and met by an
    equi-join; testing an array against a list would plan a nested loop.
    """
    cited = qa.select(*qa_key, *[b for b in batch if b not in qa_key], F.posexplode(source_ids).alias("_cited_at", chunk_id))
    known = members.select(*batch, chunk_id).distinct()
    valid = (
        cited.join(known, [*batch, chunk_id])
        .groupBy(*qa_key)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_cited_at", chunk_id))), lambda s: s[chunk_id]
            ).alias(source_ids)
        )
    )
    return qa.drop(source_ids).join(valid, list(qa_key))


def keep_listed(ids: Column, valid: Column) -> Column:
    """The same inside one row, when the batch's id list is at hand."""
    return F.filter(ids, lambda i: F.array_contains(valid, i))


def source_metadata(qa: DataFrame, chunks: DataFrame, qa_id: str, source_ids: str, chunk_id: str, book: str, chapter: str) -> DataFrame:
    """(qa_id, included_books, included_chapters): sorted distinct values of the cited chunks."""
    cited = qa.select(qa_id, F.explode_outer(source_ids).alias(chunk_id))
    meta = chunks.select(chunk_id, F.nullif(F.col(book), F.lit("")).alias("_b"), F.nullif(F.col(chapter), F.lit("")).alias("_c"))
    return cited.join(broadcast_if_small(meta), chunk_id, "left").groupBy(qa_id).agg(
        F.array_sort(F.collect_set("_b")).alias("included_books"),
        F.array_sort(F.collect_set("_c")).alias("included_chapters"),
    )


def constraint_faults(question: Column, answer: Column, quote: Column, complexity: Column | None, source_ids: Column) -> Column:
    """array<string> of the violated rules; empty for a valid pair."""
    rules = [
        F.when(F.coalesce(F.length(question), F.lit(0)) < 10, "question"),
        F.when(F.coalesce(F.length(answer), F.lit(0)) < 50, "answer"),
        F.when(F.coalesce(F.length(quote), F.lit(0)) < 20, "evidence_quote"),
        F.when(F.coalesce(F.size(source_ids), F.lit(0)) < 1, "source_chunk_ids"),
    ]
    if complexity is not None:
        rules.append(F.when(~F.coalesce(complexity.isin(COMPLEXITIES), F.lit(False)), "complexity"))
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


# --------------------------------------------------------------------- storage
def number_pairs(pairs: DataFrame, batch: Sequence[str], order: Sequence[str]) -> DataFrame:
    """0-based ``pair_index`` within a batch."""
    return row_index(pairs, batch, order, "pair_index")


def category_qa_id(batch_id: Column, category: Column, index: Column) -> Column:
    return padded_id("%s_%s_%04d", batch_id, category, index)


def evaluation_qa_id(series: Column, batch_index: Column, index: Column) -> Column:
    return padded_id("%s_rag_eval_%04d_%04d", series, batch_index, index)


def category_table(spark) -> DataFrame:
    """(category, category_name): five fixed rows."""
    return spark.createDataFrame(CATEGORIES, "category string, category_name string")


def with_category_name(qa: DataFrame) -> DataFrame:
    return qa.join(F.broadcast(category_table(qa.sparkSession)), "category", "left")


# ----------------------------------------------------------------------- audit
def sample_with_sources(qa: DataFrame, chunks: DataFrame, qa_id: str, source_ids: str, chunk_id: str, text: str, size: int, seed: str = "0") -> DataFrame:
    """A sample of pairs with the joined text of the chunks they cite.

    Three outcomes: the text, a warning when none of the cited chunks exists, or
    a note when nothing is cited.
    """
    sample = sample_by_hash(qa, qa_id, size, seed)
    cited = sample.select(qa_id, F.explode(source_ids).alias(chunk_id)).distinct()
    found = (
        broadcast_if_small(cited)
        .join(chunks.select(chunk_id, text), chunk_id)
        .groupBy(qa_id)
        .agg(F.array_sort(F.collect_list(F.struct(chunk_id, text))).alias("_found"))
    )
    shown = F.array_join(
        F.transform(
            "_found", lambda c: filled(AUDIT_BLOCK, id=c[chunk_id].cast("string"), text=c[text])
        ),
        "\n\n",
    )
    cited_list = F.array_join(F.transform(source_ids, lambda i: i.cast("string")), ", ")
    return sample.join(found, qa_id, "left").withColumn(
        "source_text",
        F.when(F.coalesce(F.size(source_ids), F.lit(0)) < 1, F.lit(NO_SOURCES))
        .when(F.col("_found").isNull(), filled(MISSING_SOURCES, ids=cited_list))
        .otherwise(shown),
    ).drop("_found")


def judge_text(sample: DataFrame, qa_id: str, source_ids: str, limit: int = 1_000) -> str:
    """A sampled audit as one prompt part, pair by pair; a sample is small by definition."""
    rows = collect_bounded(sample.orderBy(qa_id), limit, "audit sample")
    blocks = []
    for number, row in enumerate(rows, 1):
        cited = ", ".join(str(i) for i in row[source_ids] or [])
        blocks.append(
            f"Pair {number} cites {cited or 'nothing'}\nQ: {row['question']}\nA: {row['answer']}\n"
            f"Sources:\n{row['source_text']}\n"
        )
    return "\n".join(blocks)


# ------------------------------------------------------------------ statistics
def qa_totals(qa: DataFrame, source_ids: str, batch: str | None = None) -> DataFrame:
    """One row: pairs, distinct source chunks and, if asked, distinct batches.

    Every pair contributes one row per cited chunk and at least one row, and its
    first row counts the pair. No set is collected.
    """
    cited = qa.select(*([batch] if batch else []), F.posexplode_outer(source_ids).alias("_pos", "_source"))
    aggs = [
        F.count_if(F.coalesce(F.col("_pos"), F.lit(0)) == 0).alias("total_qa_pairs"),
        F.count_distinct("_source").alias("unique_source_chunks"),
    ]
    if batch:
        aggs.append(F.count_distinct(batch).alias("unique_batches"))
    return cited.agg(*aggs)


def until_abort(runs: DataFrame, group: Sequence[str], order: Sequence[str], failed: Column, limit: int = ABORT_AFTER, blocks: OrderBlocks | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The runs that still happen when a group stops at its ``limit``-th failure (that one included)."""
    flag = F.when(failed, 1).otherwise(0).cast("bigint")
    seen = running_sums(runs, group, order, {"failures": flag}, blocks, rows_per_block)
    return seen.where(F.col("failures") - flag < limit)


def progress(runs: DataFrame, group: Sequence[str], order: Sequence[str], failed: Column, pairs: Column, at: Column | None = None) -> DataFrame:
    """Counters of a resumable run: processed, failed, pairs and the last processed batch.

    With the time of each batch also when the run began and when it was last heard of. The
    failed batches themselves are rows, see ``failed_batches``.
    """
    times = [] if at is None else [F.min(at).alias("started_at"), F.max(at).alias("updated_at")]
    return runs.groupBy(*group).agg(
        F.count("*").alias("total_batches"),
        F.count_if(~failed).alias("processed_batches"),
        F.count_if(failed).alias("failed_batches"),
        F.sum(F.when(~failed, pairs).otherwise(0)).cast("bigint").alias("total_qa_pairs"),
        F.max(F.when(~failed, F.col(order[0]))).alias("last_processed"),
        *times,
    )


def failed_batches(runs: DataFrame, group: Sequence[str], batch: str, failed: Column, at: Column) -> DataFrame:
    """(group, batch, attempts, last_failed_at) of batches that failed and have not succeeded since."""
    last = F.max(F.struct(at.alias("at"), failed.alias("failed")))
    rows = runs.groupBy(*group, batch).agg(F.count_if(failed).alias("attempts"), last.alias("_l"), F.max(F.when(failed, at)).alias("last_failed_at"))
    return rows.where("_l.failed").drop("_l")


def effective_book(meta_book: Column, own_book: Column) -> Column:
    """The book named in the metadata, else the chunk's own field."""
    return or_default(meta_book, own_book)
