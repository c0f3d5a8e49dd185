"""Keyed tables: dedup, cache, upsert, delete, lookups, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeweave.functions.text import content_hash
from tomeweave.models.boundary import HashedEmbedder
from tomeweave.models.udfs import embed_column
from tomeweave.operators import incremental, tables
from tomeweave.plans.base import Catalogue, table
from tomeweave.scale import spread

catalogue = Catalogue()

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@catalogue.add(
    "q03_md5_dedup_keep_last",
    """
SELECT md5(text) AS text_hash, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(source, doc_id) AS source
FROM documents GROUP BY md5(text)
""",
)
def md5_dedup_keep_last(spark, sf):
    docs = table(spark, sf, "documents").select(
        content_hash(F.col("text")).alias("text_hash"), "doc_id", "lang", "source"
    )
    return tables.keep_last(docs, ["text_hash"], "doc_id")


@catalogue.add(
    "q15_cache_hit_miss",
    """
WITH c AS (SELECT DISTINCT md5(text) AS text_hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, md5(text) AS text_hash, md5(text) IN (SELECT text_hash FROM c) AS cached FROM documents
""",
)
def cache_hit_miss(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = known.select(content_hash(F.col("text")).alias("text_hash")).distinct()
    # A table of stored vectors; only whether one is there matters here.
    stored = cache.withColumn("embedding", F.array(F.lit(1.0)))
    return incremental.with_cache(docs, stored, "text").select(
        "doc_id", "text_hash", F.col("embedding").isNotNull().alias("cached")
    )


@catalogue.add(
    "q16_upsert_merge",
    """
WITH u AS (
  SELECT doc_id, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS quality FROM documents)
SELECT coalesce(l.doc_id, u.doc_id) AS doc_id, CAST(coalesce(u.quality, l.quality) AS INTEGER) AS quality,
       l.toxic AS toxic
FROM labels l FULL OUTER JOIN u USING (doc_id)
""",
)
def upsert_merge(spark, sf):
    base = table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").alias("toxic")
    )
    updates = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("quality")
    )
    return tables.upsert(base, updates, ["doc_id"])


@catalogue.add(
    "q17_delete_by_predicate",
    "SELECT doc_id, lang, source FROM documents WHERE NOT (source = 'src0' OR lang = 'fr')",
)
def delete_by_predicate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return tables.without(docs, (F.col("source") == "src0") | (F.col("lang") == "fr"))


@catalogue.add(
    "q18_ordered_key_lookup",
    """
SELECT 1000 - item_id AS pos, d.doc_id, d.lang, d.source FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 50
""",
)
def ordered_key_lookup(spark, sf):
    keys = table(spark, sf, "benchmark").select(
        (1000 - F.col("item_id")).alias("pos"), (F.col("item_id") * 50).alias("doc_id")
    )
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return tables.find_ordered(docs, keys, "doc_id").select("pos", "doc_id", "lang", "source")


@catalogue.add(
    "q19_optional_filter_sort_limit",
    """
SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)
WHERE lang = 'en' AND quality = 1 ORDER BY doc_id LIMIT 50
""",
)
def optional_filter_sort_limit(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    wanted = {"lang": "en", "quality": 1, "toxic": None}
    return tables.find(rows, wanted, ["doc_id"], 50).select("doc_id", "source", "quality")


@catalogue.add(
    "q38_table_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in NAMES),
)
def table_counts(spark, sf):
    return tables.table_counts({n: table(spark, sf, n) for n in NAMES})


@catalogue.add(
    "q57_duplicate_keys",
    "SELECT md5(text) AS text_hash, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    docs = table(spark, sf, "documents").select(content_hash(F.col("text")).alias("text_hash"))
    return tables.duplicate_keys(docs, ["text_hash"])


@catalogue.add(
    "q59_embed_texts",
    """
SELECT doc_id, 64 AS embedding_dim, CASE WHEN length(trim(text)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM documents
""",
)
def embed_texts(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", embed_column(F.col("text"), HashedEmbedder()).alias("_e")
    )
    squares = F.aggregate(
        "_e.embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return docs.select("doc_id", F.size("_e.embedding").alias("embedding_dim"), F.round(F.sqrt(squares), 4).alias("norm"))


@catalogue.add(
    "q64_embed_pending",
    """
WITH m AS (
  SELECT md5(text) AS text_hash, min(length(text)) AS text_length FROM documents
  WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY 1)
SELECT text_hash, text_length, 'hashed-bow' AS model, 64 AS embedding_dim FROM m
""",
)
def embed_pending(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = known.select(content_hash(F.col("text")).alias("text_hash")).distinct()
    rows = incremental.cache_rows(incremental.cache_misses(docs, cache, "text"), HashedEmbedder())
    return rows.select(
        "text_hash",
        F.col("metadata.text_length").alias("text_length"),
        "model",
        F.size("embedding").alias("embedding_dim"),
    )


@catalogue.add(
    "q66_scan_by_book",
    "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src1' ORDER BY doc_id",
)
def scan_by_book(spark, sf):
    chunks = table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.col("lang").alias("series"), F.struct(F.col("source").alias("book_name")).alias("metadata")
    )
    return tables.find(chunks, {"series": "en", "metadata.book_name": "src1"}, ["doc_id"]).select("doc_id", "n_chars")


@catalogue.add(
    "q68_vector_rows",
    """
SELECT d.doc_id, coalesce(text, '') AS text, coalesce(CAST(d.lang AS VARCHAR), '') AS universe,
       coalesce(CAST(l.quality AS VARCHAR), '') AS chapter_number
FROM documents d LEFT JOIN labels l USING (doc_id)
""",
)
def vector_rows(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    embedded = docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.array(F.lit(1.0)).alias("embedding"),
        F.col("text").alias("text_content"),
        F.lit("s").alias("series"),
        F.col("lang").alias("universe"),
        F.col("source").alias("book_name"),
        F.col("quality").alias("chapter_number"),
        F.lit(None).cast("string").alias("chapter_title"),
    )
    return incremental.vector_rows(embedded).select(
        F.col("chunk_id").cast("bigint").alias("doc_id"), "text", "universe", "chapter_number"
    )


@catalogue.add(
    "q74_zip_by_position",
    """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
v AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) AS r FROM embeddings)
SELECT doc_id, vec_id, label FROM d JOIN v USING (r)
""",
)
def zip_by_position(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    vectors = table(spark, sf, "embeddings").select("label", "vec_id")
    return incremental.zip_rows(docs, vectors, ["doc_id"], ["label", "vec_id"]).select("doc_id", "vec_id", "label")
