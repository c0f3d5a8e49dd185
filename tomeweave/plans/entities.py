"""Entities merged over shared aliases, and relationships between them, with documents as what an extraction found.

Every document states one entity whose aliases are its lines; the lines that
documents share make entities co-refer, a few of them in very many documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeweave.operators import entities, graph
from tomeweave.plans.base import Catalogue, table

catalogue = Catalogue()


def _extracts(spark, sf):
    """One extraction result for each document: its entity, and relationships to the document before and its source."""
    me = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    before = F.concat(F.lit("doc_"), (F.col("doc_id") - 1).cast("string"))
    score = (F.col("n_chars") % 100) / 100.0
    sure = F.struct(score.alias("score"), (score < 0.5).alias("needs_review"), F.lit(None).cast("string").alias("review_reason"))
    props = F.to_json(F.struct(F.col("n_chars").alias("chars"), "lang", "source"))
    entity = F.struct(
        me.alias("id"), F.col("lang").alias("type"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("name"),
        F.split("text", "\n").alias("aliases"), F.parse_json(props).alias("attributes"),
        F.array(F.struct(F.col("source").alias("file_name"), F.col("doc_id").cast("string").alias("chunk_id"))).alias("mentions"), sure.alias("confidence"),
    )
    link = lambda kind, to: F.struct(
        me.alias("source_id"), to.alias("target_id"), F.lit(kind).alias("type"), F.col("source").alias("description"),
        F.col("lang").alias("evidence"), sure.alias("confidence"),
    )
    return table(spark, sf, "documents").select(
        F.col("source").alias("file_name"), F.col("doc_id").cast("string").alias("chunk_id"),
        F.array(entity).alias("entities"), F.array(link("follows", before), link("found_in", F.col("source"))).alias("relationships"),
    )


def _statements(spark, sf):
    found = graph.vertices(_extracts(spark, sf))
    return found.withColumn("score", F.col("confidence.score"))


_MERGED = """
docs AS (SELECT 'doc_' || doc_id AS id, lang, source, n_chars, doc_id, text, (n_chars % 100) / 100.0 AS score FROM documents),
names AS (SELECT id, unnest(list_prepend('document ' || doc_id, string_split(text, chr(10)))) AS alias FROM docs),
keyed AS (SELECT id, alias, lower(trim(regexp_replace(alias, '\\s+', ' ', 'g'))) AS key FROM names),
links AS (SELECT DISTINCT id, key FROM keyed WHERE key <> ''),
firsts AS (SELECT key, min(id) AS first FROM links GROUP BY key),
edges AS (SELECT DISTINCT id AS a, first AS b FROM links JOIN firsts USING (key) WHERE id <> first),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT id, id AS r FROM docs UNION SELECT reach.id, b FROM reach JOIN both_ways ON a = r),
roots AS (SELECT id, min(r) AS root FROM reach GROUP BY id),
members AS (SELECT id, first_value(id) OVER (PARTITION BY root ORDER BY score DESC, id) AS entity FROM roots JOIN docs USING (id)),
m AS (SELECT entity, docs.* FROM members JOIN docs USING (id))
"""


@catalogue.add(
    "q78_entities_merged",
    f"""
WITH RECURSIVE {_MERGED},
kv AS (SELECT entity, 'chars' AS key, n_chars::VARCHAR AS value, score FROM m
       UNION ALL SELECT entity, 'lang', '"' || lang || '"', score FROM m UNION ALL SELECT entity, 'source', '"' || source || '"', score FROM m),
kvs AS (SELECT entity, key, value, max(score) AS s, count(*) AS n FROM kv WHERE value IS NOT NULL GROUP BY ALL),
best AS (SELECT entity, key, first(value ORDER BY s DESC, n DESC, value) AS value, count(*) AS n_values FROM kvs GROUP BY ALL),
objects AS (SELECT entity, '{{' || string_agg('"' || key || '":' || value, ',' ORDER BY key) || '}}' AS attributes,
                   count(*) FILTER (n_values > 1) AS n_conflicts FROM best GROUP BY entity),
types AS (SELECT entity, first(lang ORDER BY s DESC, n DESC, lang) AS type
          FROM (SELECT entity, lang, max(score) AS s, count(*) AS n FROM m WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY entity),
titles AS (SELECT entity, first('document ' || doc_id ORDER BY score DESC, 'document ' || doc_id) AS name FROM m GROUP BY entity)
SELECT entity, type, name, max(score)::DOUBLE AS score, count(*) AS n_ids, count(*) AS n_statements, coalesce(any_value(n_conflicts), 0) AS n_conflicts,
       any_value(attributes) AS attributes
FROM m LEFT JOIN objects USING (entity) LEFT JOIN types USING (entity) LEFT JOIN titles USING (entity) GROUP BY entity, type, name
""",
)
def entities_merged(spark, sf):
    found = entities.merge(_statements(spark, sf)).entities
    return found.withColumn("attributes", F.to_json("attributes"))


@catalogue.add(
    "q79_entity_aliases",
    f"""
WITH RECURSIVE {_MERGED}
SELECT entity, trim(alias) AS alias, count(*) AS n FROM keyed JOIN members USING (id) WHERE key <> '' GROUP BY ALL
""",
)
def entity_aliases(spark, sf):
    return entities.merge(_statements(spark, sf)).aliases


@catalogue.add(
    "q80_entity_mentions",
    f"""
WITH RECURSIVE {_MERGED}
SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY source, doc_id::VARCHAR) - 1 AS position,
       source AS file_name, doc_id::VARCHAR AS chunk_id, 1::BIGINT AS n FROM m
""",
)
def entity_mentions(spark, sf):
    return entities.merge(_statements(spark, sf)).mentions


@catalogue.add(
    "q81_relationships_merged",
    f"""
WITH RECURSIVE {_MERGED},
rel AS (SELECT id AS s, 'follows' AS type, 'doc_' || (doc_id - 1) AS t, source, lang, score, doc_id FROM docs
        UNION ALL SELECT id, 'found_in', source, source, lang, score, doc_id FROM docs),
named AS (SELECT coalesce(a.entity, s) AS source_id, type, coalesce(b.entity, t) AS target_id, source, lang, score, doc_id
          FROM rel LEFT JOIN members a ON a.id = s LEFT JOIN members b ON b.id = t)
SELECT source_id, type, target_id, first(source ORDER BY score DESC NULLS LAST, source, lang) AS description,
       first(lang ORDER BY score DESC NULLS LAST, source, lang) AS evidence, max(score)::DOUBLE AS score,
       count(*) AS n_statements, count(DISTINCT (source, doc_id)) AS n_sources
FROM named WHERE source_id IS DISTINCT FROM target_id GROUP BY source_id, type, target_id
""",
)
def relationships_merged(spark, sf):
    extracts = graph.stamp_provenance(_extracts(spark, sf), F.col("file_name"), F.col("chunk_id"))
    stated = graph.edges(extracts).withColumn("score", F.col("confidence.score"))
    members = entities.merge(graph.vertices(extracts).withColumn("score", F.col("confidence.score"))).members
    return entities.merge_relationships(stated, members)
