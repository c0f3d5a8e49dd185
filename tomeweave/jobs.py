"""The end-to-end jobs: ingest, sections, embed, load, extract, question-answer generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave import schemas
from tomeweave.constants import CATEGORIES, EVAL_BATCH, QA_BATCH, QA_OVERLAP
from tomeweave.functions.policy import safe_limit
from tomeweave.functions.text import filled, slugify
from tomeweave.models.boundary import Embedder, Generator, Retry
from tomeweave.models.udfs import generate_column
from tomeweave.operators import analyze, chunking, graph, incremental, packing, qna, tables
from tomeweave.operators.tables import TableStore
from tomeweave.scale import once
from tomeweave.session import cut_lineage
from tomeweave.sources import files

PAIRS = """qa_pairs ARRAY<STRUCT<question: STRING, answer: STRING, complexity: STRING, evidence_quote: STRING,
    source_chunk_ids: ARRAY<STRING>>>"""

CATEGORY_PROMPT = (
    "Write question-answer pairs about {name} from the text below. Answer only from it, quote the evidence word for "
    "word, and list every chunk id the answer needs. Reply as JSON with a list qa_pairs.\n{text}"
)
EVALUATION_PROMPT = (
    "Write question-answer pairs from the chunks below. Only these chunk ids may be named: {ids}. Reply as JSON with "
    "a list qa_pairs.\n\n{text}"
)
ONTOLOGY_PROMPT = "Write the entity and relationship types of the series {series} as a JSON ontology."
JUDGE_PROMPT = "Compare the two samples of question-answer pairs and report which is better grounded.\n\n{a}\n\n{b}"
EXTRACTION_PROMPT = (
    "Extract the entities and relationships of the text as JSON under this ontology:\n{ontology}\n\nText:\n{text}"
)


def _series_id(name: str) -> str:
    return name.lower().replace(" ", "_")


# ---------------------------------------------------------------------- ingest
def ingest(
    spark: SparkSession,
    folder: str,
    universe: str,
    store: TableStore | None = None,
    recursive: bool = False,
    output: str | None = None,
    rejects: str | None = None,
) -> DataFrame:
    """Books to chunks. Stores them when a store is given, else only reports; returns the summary row.

    Books that cannot be read give no chunks; ``rejects`` is a folder to list them in.
    """
    found = files.book_files(spark, folder, recursive)
    books = files.ordered_books(found, nested=recursive)
    if rejects:
        files.unreadable(books).write.mode("overwrite").json(rejects)
    rows = cut_lineage(chunking.rag_chunks(books.where(F.length("text") > 0), universe), "rag-chunks")
    if store is not None:
        store.bulk_upsert("rag_chunks", rows)
    if output:
        analyze.export(rows.select("chunk_id", "series", "text_content", "character_count", "metadata.*"), output)
    flat = rows.select("character_count", "metadata.*")
    return analyze.summary(flat, F.col("character_count"))


def pack_series(
    spark: SparkSession,
    root: str,
    series: str,
    context_window: int,
    safety_margin: float = 0.1,
    store: TableStore | None = None,
    output: str | None = None,
) -> DataFrame:
    """A series' books packed into sections of one model context each."""
    books = files.ordered_books(files.series_files(spark, root, series)).withColumn("series", F.lit(series))
    books = books.withColumn("book_file", F.regexp_extract("path", r"([^/]+)$", 1))
    packed = packing.sections(
        books, "series", "book_order", "book_file", safe_limit(context_window, safety_margin)
    )
    rows = cut_lineage(
        packed.select(
            "chunk_id",
            "series",
            "text_content",
            "token_count",
            "character_count",
            F.lit(context_window).cast("bigint").alias("context_window_used"),
            F.lit(safety_margin).alias("safety_margin"),
            "included_books",
            F.current_timestamp().alias("created_at"),
        ),
        "sections",
    )
    if store is not None:
        store.bulk_upsert("graph_chunks", rows)
    if output:
        files.write_sections(rows, output)
    return rows


# --------------------------------------------------------------- embed and load
def embed(store: TableStore, universe: str, path: str, model: Embedder, retry: Retry | None = None) -> None:
    """Embed a series' chunks that are not in the Parquet folder yet."""
    chunks = tables.find(store.read("rag_chunks"), {"series": _series_id(universe)})
    incremental.embed_pending(chunks, path, model, retry)


def load_vectors(store: TableStore, path: str) -> int:
    """Embedded rows into the vector table, keyed by chunk; the newest row of a chunk counts."""
    embedded = store.spark.read.schema(schemas.struct_of("embeddings")).parquet(path)
    incremental.require_columns(embedded, ["embedding", "chunk_id", "text_content"])
    newest = tables.keep_last(embedded, ["chunk_id"], "embedded_at").dropDuplicates(["chunk_id"])
    return store.bulk_upsert("vectors", incremental.vector_rows(newest))


def embed_with_cache(store: TableStore, texts: DataFrame, text: str, model: Embedder, retry: Retry | None = None) -> DataFrame:
    """``texts`` with their embeddings; unknown texts are embedded once each and stored by hash."""
    cache = store.read("embedding_cache")
    fresh = cut_lineage(incremental.cache_rows(incremental.cache_misses(texts, cache, text, model.name), model, retry), "fresh")
    store.bulk_upsert("embedding_cache", fresh)
    return incremental.with_cache(texts, store.read("embedding_cache"), text, model.name)


# ------------------------------------------------------------------- extraction
def extract_entities(
    store: TableStore, sections: DataFrame, ontology: str, model: Generator, retry: Retry | None = None
) -> int:
    """Sections (section_id, series, file_name, text) without a stored extraction, through the model.

    A reply that does not parse leaves no row, so its section comes again.
    """
    done = store.read("extraction_results").select(F.col("chunk_id").alias("section_id"))
    todo = files.pending_sections(sections, done)
    prompt = filled(EXTRACTION_PROMPT, ontology=F.lit(ontology), text=F.col("text"))
    replies = todo.withColumn("_r", generate_column(prompt, model, retry))
    parsed = replies.withColumn("_x", F.from_json("_r.content", schemas.EXTRACTION_FILE)).where(
        F.col("_r.error").isNull() & F.col("_x.entities").isNotNull()
    )
    kept = cut_lineage(parsed.select("section_id", "series", "file_name", "_x.*"), "extracts")
    stamped = graph.stamp_provenance(kept, F.col("file_name"), F.col("section_id"))
    return store.bulk_upsert(
        "extraction_results", stamped.withColumnRenamed("section_id", "chunk_id").drop("file_name")
    )


def extract_series(store: TableStore, series: str, model: Generator, retry: Retry | None = None) -> int:
    """Extract from the stored sections of a series under its stored ontology."""
    found = tables.find_one(store.read("schemas"), {"series": series}).select(F.to_json(F.struct("*"))).first()
    if found is None:
        raise ValueError(f"no ontology for series {series}")
    sections = tables.find(store.read("graph_chunks"), {"series": series}).select(
        F.col("chunk_id").alias("section_id"),
        "series",
        F.concat("chunk_id", F.lit(".txt")).alias("file_name"),
        F.col("text_content").alias("text"),
    )
    return extract_entities(store, sections, found[0], model, retry)


def generate_ontology(store: TableStore, series: list[str], model: Generator, retry: Retry | None = None) -> int:
    """An ontology per series from the model, stored by series; replies that do not parse leave none."""
    rows = store.spark.createDataFrame([(s,) for s in series], "series string")
    asked = rows.withColumn("_r", generate_column(filled(ONTOLOGY_PROMPT, series=F.col("series")), model, retry))
    parsed = asked.withColumn("_o", F.from_json("_r.content", schemas.ONTOLOGY_FILE)).where(
        F.col("_o.entity_types").isNotNull()
    )
    kept = cut_lineage(
        parsed.select(
            "series",
            *[
                F.col(f"_o.{c}").alias(c)
                for c in ("version_info", "entity_types", "relationship_types", "canonical_renaming_rules")
            ],
        ),
        "ontologies",
    )
    return store.bulk_upsert("schemas", kept)


# ----------------------------------------------------------------- QA datasets
def _ask(texts: DataFrame, keys: list[str], prompt: Column, model: Generator, retry: Retry | None) -> DataFrame:
    """One row per parsed pair. Replies are written once, so no model call is ever repeated by a later stage."""
    asked = texts.withColumn("_r", generate_column(prompt, model, retry))
    replies = cut_lineage(asked.select(*keys, "_r"), "replies")
    parsed = replies.where(F.col("_r.error").isNull()).withColumn("_p", F.from_json("_r.content", PAIRS))
    return parsed.select(*keys, F.posexplode(once(F.col("_p.qa_pairs"))).alias("_pos", "_q")).select(*keys, "_pos", "_q.*")


def _series_chunks(store: TableStore, series: str) -> DataFrame:
    chunks = tables.find(store.read("rag_chunks"), {"series": series})
    return chunks.select("chunk_id", "series", "text_content", "metadata.book_name", "metadata.chapter_title")


def generate_category_pairs(
    store: TableStore,
    series: str,
    category: str,
    model: Generator,
    retry: Retry | None = None,
    batch_size: int = QA_BATCH,
    batch_overlap: int = QA_OVERLAP,
    skip_processed: bool = True,
) -> int:
    """Overlapping batches of a series through the model; stored pairs of a regenerated batch are replaced."""
    name = dict(CATEGORIES)[category]
    members = qna.overlapping_members(
        _series_chunks(store, series), ["series"], ["chunk_id"], batch_size, batch_overlap
    )
    batches = members.groupBy("series", "batch_index").agg(
        F.array_sort(F.collect_list("chunk_id")).alias("all_batch_chunk_ids"),
        F.array_sort(F.collect_set(F.nullif("book_name", F.lit("")))).alias("included_books"),
    )
    ids = F.col("all_batch_chunk_ids")
    batches = batches.withColumn("batch_id", F.concat(F.element_at(ids, 1), F.lit("_to_"), F.element_at(ids, -1)))
    stored = store.read("qa_pairs")
    if skip_processed:
        done = qna.processed_batches(
            stored, {"metadata.series": series, "category": category}, "metadata.source_batch_id"
        )
        batches = qna.pending_batches(batches, done)
    batches = cut_lineage(batches, "batches")
    wanted = members.join(batches.select("series", "batch_index"), ["series", "batch_index"], "left_semi")
    texts = qna.batch_text(wanted, ["series"], "chunk_id", "text_content")
    prompt = filled(CATEGORY_PROMPT, name=F.lit(name), text=F.col("batch_text"))
    pairs = _ask(texts, ["series", "batch_index"], prompt, model, retry).join(batches, ["series", "batch_index"])
    faults = qna.constraint_faults(
        F.col("question"), F.col("answer"), F.col("evidence_quote"), F.col("complexity"), F.col("source_chunk_ids")
    )
    numbered = qna.number_pairs(pairs.where(F.size(faults) == 0), ["batch_id"], ["_pos"])
    rows = numbered.select(
        qna.category_qa_id(F.col("batch_id"), F.lit(category), F.col("pair_index")).alias("qa_id"),
        "question",
        "answer",
        F.lit(category).alias("category"),
        "complexity",
        "evidence_quote",
        F.struct(
            F.col("batch_id").alias("source_batch_id"),
            "source_chunk_ids",
            "all_batch_chunk_ids",
            "included_books",
            F.lit(None).cast("array<string>").alias("included_chapters"),
            "series",
            F.lit(None).cast("int").alias("batch_index"),
            F.lit(model.name).alias("generation_model"),
            F.lit(name).alias("category_name"),
        ).alias("metadata"),
    )
    return _replace_batches(store, cut_lineage(rows, "pairs"), ["category", "metadata.source_batch_id"])


def generate_evaluation_pairs(
    store: TableStore,
    series: str,
    model: Generator,
    retry: Retry | None = None,
    batch_size: int = EVAL_BATCH,
    start_batch: int = 0,
    max_batches: int | None = None,
    skip_processed: bool = True,
) -> int:
    """Consecutive batches through the model; ids a reply makes up are taken out."""
    members = qna.tumbling_members(
        _series_chunks(store, series), ["series"], ["chunk_id"], batch_size, start_batch, max_batches
    )
    if skip_processed:
        stored = store.read("qa_pairs").where(
            (F.col("metadata.series") == series) & (F.col("category") == "rag_evaluation")
        )
        done = stored.select(F.col("metadata.batch_index").cast("bigint").alias("batch_index")).distinct()
        members = members.join(done, "batch_index", "left_anti")
    members = cut_lineage(members, "members")
    texts = qna.batch_text(
        members, ["series"], "chunk_id", "text_content", "evaluation", F.col("book_name"), F.col("chapter_title")
    )
    prompt = filled(EVALUATION_PROMPT, ids=F.col("chunk_ids"), text=F.col("batch_text"))
    pairs = _ask(texts, ["series", "batch_index"], prompt, model, retry)
    faults = qna.constraint_faults(
        F.col("question"), F.col("answer"), F.col("evidence_quote"), None, F.col("source_chunk_ids")
    )
    valid = qna.validate_source_ids(
        pairs.where(F.size(faults) == 0),
        members,
        ["series", "batch_index", "_pos"],
        ["series", "batch_index"],
        "source_chunk_ids",
        "chunk_id",
    )
    numbered = qna.number_pairs(cut_lineage(valid, "valid"), ["series", "batch_index"], ["_pos"])
    named = numbered.withColumn(
        "qa_id", qna.evaluation_qa_id(slugify(F.col("series")), F.col("batch_index"), F.col("pair_index"))
    )
    meta = qna.source_metadata(named, members, "qa_id", "source_chunk_ids", "chunk_id", "book_name", "chapter_title")
    rows = named.join(meta, "qa_id").select(
        "qa_id",
        "question",
        "answer",
        F.lit("rag_evaluation").alias("category"),
        F.lit("rag_eval").alias("complexity"),
        "evidence_quote",
        F.struct(
            F.lit(None).cast("string").alias("source_batch_id"),
            "source_chunk_ids",
            F.lit(None).cast("array<string>").alias("all_batch_chunk_ids"),
            "included_books",
            "included_chapters",
            "series",
            F.col("batch_index").cast("int").alias("batch_index"),
            F.lit(model.name).alias("generation_model"),
            F.lit(None).cast("string").alias("category_name"),
        ).alias("metadata"),
    )
    return _replace_batches(store, cut_lineage(rows, "pairs"), ["category", "metadata.series", "metadata.batch_index"])


def _replace_batches(store: TableStore, rows: DataFrame, batch: list[str]) -> int:
    """Drop the stored pairs of every batch that is written again, then upsert its new pairs."""
    names = [f"_k{i}" for i in range(len(batch))]
    keyed = lambda df: df.withColumns({n: F.col(b) for n, b in zip(names, batch)})
    again = keyed(rows).select(*names).distinct()
    stored = store.read("qa_pairs")
    stale = keyed(stored).join(again, names, "left_semi").join(rows.select("qa_id"), "qa_id", "left_anti")
    if stale.limit(1).count():
        store.replace("qa_pairs", stored.join(stale.select("qa_id"), "qa_id", "left_anti"))
    return store.bulk_upsert("qa_pairs", rows)


def qa_report(store: TableStore, series: str) -> DataFrame:
    """Pairs and distinct source chunks of a series, and counts by category and complexity, as rows."""
    pairs = store.read("qa_pairs").where(F.col("metadata.series") == series)
    totals = qna.qa_totals(pairs.select(F.col("metadata.source_chunk_ids").alias("ids")), "ids")
    stacked = totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit("total").alias("dimension"), F.lit(c).alias("value"), F.col(c).alias("n"))
                    for c in ("total_qa_pairs", "unique_source_chunks")
                ]
            )
        ).alias("_t")
    ).select("_t.*")
    by = analyze.value_counts(pairs, {"category": F.col("category"), "complexity": F.col("complexity")})
    return stacked.unionByName(by)


def judge_quality(store: TableStore, first: str, second: str, judge: Generator, size: int = 5, seed: str = "0") -> str:
    """A model's verdict on samples of pairs generated by two models, each with its source text."""
    chunks = store.read("rag_chunks").select("chunk_id", "text_content")
    parts = []
    for name in (first, second):
        pairs = store.read("qa_pairs").where(F.col("metadata.generation_model") == name)
        flat = pairs.select("qa_id", "question", "answer", F.col("metadata.source_chunk_ids").alias("ids"))
        audit = qna.sample_with_sources(flat, chunks, "qa_id", "ids", "chunk_id", "text_content", size, seed)
        parts.append(f"Model {name}\n" + qna.judge_text(audit, "qa_id", "ids"))
    return judge.generate([JUDGE_PROMPT.replace("{a}", parts[0]).replace("{b}", parts[1])])[0]["content"]
