"""Constraints, progress, waits, positional zips and anti-joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeweave.constants import SERIES_ONTOLOGY
from tomeweave.functions.policy import backoff_seconds
from tomeweave.functions.text import words
from tomeweave.models.boundary import CATEGORY_RETRY, EMBED_RETRY, EVALUATION_RETRY
from tomeweave.operators import analyze, graph, incremental, qna
from tomeweave.plans.base import Catalogue, table
from tomeweave.sources import files

catalogue = Catalogue()


@catalogue.add(
    "q92_retry_waits",
    """
WITH a AS (SELECT event_id, event_type = 'error' AS limited, 2.0 * pow(2, event_id % 6) AS d FROM events)
SELECT event_id, CASE WHEN limited THEN greatest(d, 60) ELSE d END::DOUBLE AS embedding,
       greatest(10, least(120, d))::DOUBLE AS category, greatest(4, least(60, d))::DOUBLE AS evaluation
FROM a
""",
)
def retry_waits(spark, sf):
    kind = F.when(F.col("event_type") == "error", "rate_limit").otherwise("other")
    attempt = F.col("event_id") % 6 + 1
    waits = {"embedding": EMBED_RETRY, "category": CATEGORY_RETRY, "evaluation": EVALUATION_RETRY}
    return table(spark, sf, "events").select(
        "event_id",
        *[backoff_seconds(kind, attempt, r.base, r.least, None if r.most == float("inf") else r.most, r.floor).alias(n) for n, r in waits.items()],
    )


@catalogue.add(
    "q93_extraction_faults",
    """
WITH d AS (SELECT doc_id, lang, source, text, (n_chars % 130) / 100.0 AS score FROM documents)
SELECT doc_id, 'entities' AS part, 0 AS position, 'name' AS fault FROM d WHERE length(trim(split_part(text, chr(10), 2))) < 1
UNION ALL SELECT doc_id, 'entities', 0, 'score' FROM d WHERE score > 1
UNION ALL SELECT doc_id, 'relationships', 0, 'score' FROM d WHERE score > 1
UNION ALL SELECT doc_id, 'schema_proposals', 0, 'proposal_type' FROM d WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT doc_id, 'schema_proposals', 0, 'confidence' FROM d WHERE score - 0.5 NOT BETWEEN 0 AND 1
""",
)
def extraction_faults(spark, sf):
    """Results whose entity is named by a text's second line, with scores from 0 to 1.29."""
    score = (F.col("n_chars") % 130) / 100.0
    sure = F.struct(score.alias("score"), F.lit(False).alias("needs_review"), F.lit(None).cast("string").alias("review_reason"))
    me = F.col("doc_id").cast("string")
    kind = F.when(F.col("lang") == "en", "new_entity_type").when(F.col("lang") == "de", "new_renaming_rule").otherwise(F.col("lang"))
    name = F.trim(F.coalesce(F.get(F.split("text", "\\n"), F.lit(1)), F.lit("")))
    results = table(spark, sf, "documents").select(
        "doc_id",
        F.array(F.struct(me.alias("id"), F.col("lang").alias("type"), name.alias("name"), sure.alias("confidence"))).alias("entities"),
        F.array(F.struct(me.alias("source_id"), F.col("source").alias("target_id"), F.col("lang").alias("type"), sure.alias("confidence"))).alias("relationships"),
        F.array(F.struct(kind.alias("proposal_type"), me.alias("name"), (score - 0.5).alias("confidence"))).alias("schema_proposals"),
    )
    return graph.extraction_faults(results, "doc_id")


_RUNS = "WITH r AS (SELECT user_id, event_id, event_type, event_type = 'error' AS failed, epoch_us(ts) AS us, 1 AS one FROM events)"


@catalogue.add(
    "q94_progress_with_times",
    f"""
{_RUNS}
SELECT user_id, count(*) AS total_batches, count(*) FILTER (NOT failed) AS processed_batches, count(*) FILTER (failed) AS failed_batches,
       coalesce(sum(one) FILTER (NOT failed), 0)::BIGINT AS total_qa_pairs, max(event_id) FILTER (NOT failed) AS last_processed, min(us) AS started_at, max(us) AS updated_at
FROM r GROUP BY user_id
""",
)
def progress_with_times(spark, sf):
    runs = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return qna.progress(runs, ["user_id"], ["event_id"], F.col("event_type") == "error", F.lit(1), micros)


@catalogue.add(
    "q95_failed_batches",
    f"""
{_RUNS},
k AS (SELECT user_id, event_id % 7 AS batch, failed, us FROM r)
SELECT user_id, batch, count(*) FILTER (failed) AS attempts, max(us) FILTER (failed) AS last_failed_at
FROM k GROUP BY user_id, batch HAVING arg_max(failed, (us, failed))
""",
)
def failed_batches(spark, sf):
    runs = table(spark, sf, "events").withColumn("batch", F.col("event_id") % 7)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return qna.failed_batches(runs, ["user_id"], "batch", F.col("event_type") == "error", micros)


@catalogue.add(
    "q96_zip_with_tail",
    """
WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM customer),
s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS position FROM supplier)
SELECT position, c_custkey, s_suppkey, CASE WHEN c_custkey IS NULL THEN 'right' WHEN s_suppkey IS NULL THEN 'left' ELSE 'both' END AS status
FROM c FULL OUTER JOIN s USING (position)
""",
)
def zip_with_tail(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    right = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    zipped = incremental.zip_all(left, right, ["c_acctbal", "c_custkey"], ["s_acctbal", "s_suppkey"])
    return zipped.select("position", "c_custkey", "s_suppkey", "status")


_SERIES = sorted(SERIES_ONTOLOGY)
_LISTED = ", ".join(f"('{k}', '{SERIES_ONTOLOGY[k][0]}', '{SERIES_ONTOLOGY[k][1]}')" for k in _SERIES)


@catalogue.add(
    "q97_pending_sections",
    f"""
WITH known(series, ontology, prefix) AS (VALUES {_LISTED}),
d AS (SELECT doc_id::VARCHAR AS section_id, CASE lang {" ".join(f"WHEN '{lang}' THEN '{k}'" for lang, k in zip(("en", "de", "fr"), _SERIES, strict=False))} ELSE source END AS series FROM documents),
slug AS (SELECT section_id, d.series, coalesce(ontology, d.series) AS o, coalesce(prefix, lower(regexp_replace(d.series, ' ', '_', 'g'))) AS prefix
         FROM d LEFT JOIN known ON known.series = d.series)
SELECT section_id, series, lower(replace(o, ' ', '_')) || '_schema.json' AS ontology_file, prefix
FROM slug WHERE section_id NOT IN (SELECT doc_id::VARCHAR FROM labels)
""",
)
def pending_sections(spark, sf):
    """Sections of which no extraction (here: no label) exists, with their series' ontology and prefix."""
    named = F.col("source")
    for lang, series in zip(("en", "de", "fr"), _SERIES, strict=False):
        named = F.when(F.col("lang") == lang, series).otherwise(named)
    sections = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("section_id"), named.alias("series"))
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("section_id"))
    return files.with_settings(files.pending_sections(sections, done), "series").select("section_id", "series", "ontology_file", "prefix")


@catalogue.add(
    "q98_distinct_words_per_source",
    """
SELECT source, count(DISTINCT w) AS n_words
FROM (SELECT source, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY source
""",
)
def distinct_words_per_source(spark, sf):
    return analyze.distinct_member_counts(table(spark, sf, "documents"), ["source"], words(F.col("text")), "n_words")
