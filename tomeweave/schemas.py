"""Schemas of the logical tables, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import types as T

DDL = {
    "rag_chunks": """chunk_id STRING, series STRING, text_content STRING, character_count BIGINT,
        metadata STRUCT<book_name: STRING, chapter_number: STRING, chapter_title: STRING, universe: STRING>,
        created_at TIMESTAMP, updated_at TIMESTAMP""",
    "graph_chunks": """chunk_id STRING, series STRING, text_content STRING, token_count BIGINT,
        character_count BIGINT, context_window_used BIGINT, safety_margin DOUBLE,
        included_books ARRAY<STRING>, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "extraction_results": """chunk_id STRING, series STRING,
        entities ARRAY<STRUCT<id: STRING, type: STRING, name: STRING, aliases: ARRAY<STRING>, attributes: STRING,
            description: STRING, mentions: ARRAY<STRUCT<file_name: STRING, chunk_id: STRING>>,
            confidence: STRUCT<score: DOUBLE, needs_review: BOOLEAN, review_reason: STRING>>>,
        relationships ARRAY<STRUCT<source_id: STRING, target_id: STRING, type: STRING, description: STRING,
            evidence: STRING, properties: STRING, source_ref: STRUCT<file_name: STRING, chunk_id: STRING>,
            confidence: STRUCT<score: DOUBLE, needs_review: BOOLEAN, review_reason: STRING>>>,
        schema_proposals ARRAY<STRUCT<proposal_type: STRING, name: STRING, description: STRING, confidence: DOUBLE>>,
        created_at TIMESTAMP, updated_at TIMESTAMP""",
    "schemas": """series STRING,
        version_info STRUCT<version: STRING, created_at: STRING, changelog: ARRAY<STRING>,
            evolution_suggestions: ARRAY<STRING>>,
        entity_types ARRAY<STRUCT<name: STRING, description: STRING, attributes: ARRAY<STRING>>>,
        relationship_types ARRAY<STRUCT<name: STRING, description: STRING, source_type: STRING,
            target_type: STRING, properties: ARRAY<STRING>>>,
        canonical_renaming_rules MAP<STRING, STRING>, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "embedding_cache": """text_hash STRING, model STRING, embedding ARRAY<FLOAT>,
        metadata STRUCT<text_length: BIGINT>, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "embeddings": """chunk_id STRING, series STRING, text_content STRING, character_count BIGINT, book_name STRING,
        chapter_number STRING, chapter_title STRING, universe STRING, embedding ARRAY<FLOAT>,
        embedding_model STRING, embedding_dim INT, embedded_at TIMESTAMP""",
    "vectors": """embedding ARRAY<FLOAT>, text STRING, chunk_id STRING, series STRING, universe STRING,
        book_title STRING, chapter_number STRING, chapter_title STRING""",
    "qa_pairs": """qa_id STRING, question STRING, answer STRING, category STRING, complexity STRING,
        evidence_quote STRING,
        metadata STRUCT<source_batch_id: STRING, source_chunk_ids: ARRAY<STRING>,
            all_batch_chunk_ids: ARRAY<STRING>, included_books: ARRAY<STRING>, included_chapters: ARRAY<STRING>,
            series: STRING, batch_index: INT, generation_model: STRING, category_name: STRING>,
        created_at TIMESTAMP, updated_at TIMESTAMP""",
    "usage": """input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT, cached_tokens BIGINT,
        reasoning_tokens BIGINT, input_cost_usd DOUBLE, output_cost_usd DOUBLE, total_cost_usd DOUBLE,
        provider STRING, model STRING, timestamp DOUBLE, api_key_last4 STRING""",
}

# The unique key of each stored table.
KEYS = {
    "rag_chunks": ["chunk_id"],
    "graph_chunks": ["chunk_id"],
    "extraction_results": ["chunk_id"],
    "schemas": ["series"],
    "embedding_cache": ["text_hash", "model"],
    "vectors": ["chunk_id"],
    "embeddings": ["chunk_id"],
    "qa_pairs": ["qa_id"],
}

# Extraction files as a model writes them, and ontology files.
EXTRACTION_FILE = """entities ARRAY<STRUCT<id: STRING, type: STRING, name: STRING, aliases: ARRAY<STRING>,
        attributes: STRING, description: STRING, mentions: ARRAY<STRUCT<file_name: STRING, chunk_id: STRING>>,
        confidence: STRUCT<score: DOUBLE, needs_review: BOOLEAN, review_reason: STRING>>>,
    relationships ARRAY<STRUCT<source_id: STRING, target_id: STRING, type: STRING, description: STRING,
        evidence: STRING, properties: STRING, source_ref: STRUCT<file_name: STRING, chunk_id: STRING>,
        confidence: STRUCT<score: DOUBLE, needs_review: BOOLEAN, review_reason: STRING>>>,
    schema_proposals ARRAY<STRUCT<proposal_type: STRING, name: STRING, description: STRING, confidence: DOUBLE>>"""
ONTOLOGY_FILE = """series_name STRING,
    version_info STRUCT<version: STRING, created_at: STRING, changelog: ARRAY<STRING>,
        evolution_suggestions: ARRAY<STRING>>,
    entity_types ARRAY<STRUCT<name: STRING, description: STRING, attributes: ARRAY<STRING>>>,
    relationship_types ARRAY<STRUCT<name: STRING, description: STRING, source_type: STRING, target_type: STRING,
        properties: ARRAY<STRING>>>,
    canonical_renaming_rules MAP<STRING, STRING>"""


def struct_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
