"""Question-answer datasets over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeweave.functions.text import words
from tomeweave.operators import analyze, qna
from tomeweave.plans.base import Catalogue, event_micros, first_line, table
from tomeweave.scale import spread

catalogue = Catalogue()


def _docs(spark, sf, *columns):
    return table(spark, sf, "documents").select(*(columns or ("doc_id", "lang", "source", "text")))


def _measured(spark, sf):
    return qna.measured(spread(_docs(spark, sf), "doc_id"), "text")


_TUMBLING = """
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn FROM documents),
m AS (SELECT *, rn // 100 AS batch_index FROM i)
"""
_OVERLAP = """
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn FROM documents),
n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
w AS (SELECT lang, unnest(range(0, n, 8)) AS s FROM n),
m AS (SELECT i.*, w.s // 8 AS batch_index FROM w JOIN i ON i.lang = w.lang AND i.rn >= w.s AND i.rn < w.s + 10)
"""


def _describe_sql(members):
    return f"""
{members},
b AS (
  SELECT lang, batch_index, arg_min(doc_id, rn) AS first_chunk, arg_max(doc_id, rn) AS last_chunk, count(*) AS n_chunks,
         string_agg(DISTINCT source, ',' ORDER BY source) AS included_books,
         CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS token_count,
         CAST(sum(length(text)) // 4 AS BIGINT) AS estimated_tokens
  FROM m GROUP BY lang, batch_index)
"""


_BATCH_COLUMNS = (
    "lang, batch_index, first_chunk || '_to_' || last_chunk AS batch_id, n_chunks, included_books, token_count, "
    "estimated_tokens"
)


def _described(members):
    batches = qna.describe_batches(
        members, ["lang"], "doc_id", F.col("source"), F.col("n_tokens"), F.col("n_characters")
    )
    return batches.select(
        "lang",
        "batch_index",
        "batch_id",
        "n_chunks",
        F.array_join("included_books", ",").alias("included_books"),
        "token_count",
        "estimated_tokens",
    )


@catalogue.add("q28_tumbling_batches", f"WITH {_describe_sql(_TUMBLING)} SELECT {_BATCH_COLUMNS} FROM b")
def tumbling_batches(spark, sf):
    return _described(qna.tumbling_members(_measured(spark, sf), ["lang"], ["doc_id"]))


@catalogue.add("q29_overlap_batches", f"WITH {_describe_sql(_OVERLAP)} SELECT {_BATCH_COLUMNS} FROM b")
def overlap_batches(spark, sf):
    return _described(qna.overlapping_members(_measured(spark, sf), ["lang"], ["doc_id"]))


@catalogue.add(
    "q30_skip_processed",
    f"""
WITH {_OVERLAP},
b AS (SELECT lang, batch_index, arg_min(doc_id, rn) AS f, arg_max(doc_id, rn) AS l FROM m GROUP BY lang, batch_index)
SELECT lang, batch_index, f || '_to_' || l AS batch_id FROM b
WHERE f NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
""",
)
def skip_processed(spark, sf):
    members = qna.overlapping_members(_docs(spark, sf, "doc_id", "lang"), ["lang"], ["doc_id"])
    at = F.col("row_index")
    batches = (
        members.groupBy("lang", "batch_index")
        .agg(F.min_by("doc_id", at).alias("first_chunk"), F.max_by("doc_id", at).alias("last_chunk"))
        .withColumn("batch_id", F.concat(F.col("first_chunk").cast("string"), F.lit("_to_"), F.col("last_chunk").cast("string")))
    )
    # Stored pairs: those of batches whose first chunk has a label.
    stored = batches.join(
        table(spark, sf, "labels").select(F.col("doc_id").alias("first_chunk"), "quality"), "first_chunk"
    )
    done = qna.processed_batches(stored, {"quality": 1}, "batch_id")
    return qna.pending_batches(batches, done).select("lang", "batch_index", "batch_id")


_CITED = "SELECT doc_id, lang, [doc_id + 50, doc_id, doc_id + 1, doc_id * 2] AS ids FROM documents"


def _cited():
    me = F.col("doc_id")
    return F.array(me + 50, me, me + 1, me * 2)


@catalogue.add(
    "q31_valid_id_semijoin",
    f"""
WITH {_TUMBLING},
c AS (SELECT doc_id AS qa_id, lang, batch_index, unnest([doc_id + 50, doc_id + 1, doc_id * 2]) AS cid,
             unnest([0, 1, 2]) AS pos FROM m)
SELECT c.qa_id, string_agg(CAST(c.cid AS VARCHAR), ',' ORDER BY pos) AS source_chunk_ids
FROM c JOIN m ON m.lang = c.lang AND m.batch_index = c.batch_index AND m.doc_id = c.cid GROUP BY c.qa_id
""",
)
def valid_id_semijoin(spark, sf):
    members = qna.tumbling_members(_docs(spark, sf, "doc_id", "lang"), ["lang"], ["doc_id"])
    me = F.col("doc_id")
    pairs = members.select(
        F.col("doc_id").alias("qa_id"), "lang", "batch_index", F.array(me + 50, me + 1, me * 2).alias("source_chunk_ids")
    )
    kept = qna.validate_source_ids(
        pairs, members, ["qa_id"], ["lang", "batch_index"], "source_chunk_ids", "doc_id"
    )
    return kept.select("qa_id", F.array_join("source_chunk_ids", ",").alias("source_chunk_ids"))


@catalogue.add(
    "q32_source_metadata_lookup",
    f"""
WITH c AS (SELECT doc_id AS qa_id, unnest(ids) AS doc_id FROM ({_CITED}))
SELECT qa_id, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS included_books,
       coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS included_chapters
FROM c LEFT JOIN documents d USING (doc_id) GROUP BY qa_id
""",
)
def source_metadata_lookup(spark, sf):
    docs = _docs(spark, sf, "doc_id", "lang", "source")
    pairs = docs.select(F.col("doc_id").alias("qa_id"), _cited().alias("source_chunk_ids"))
    found = qna.source_metadata(pairs, docs, "qa_id", "source_chunk_ids", "doc_id", "source", "lang")
    return found.select(
        "qa_id",
        F.array_join("included_books", ",").alias("included_books"),
        F.array_join("included_chapters", ",").alias("included_chapters"),
    )


@catalogue.add(
    "q33_sample_audit_join",
    """
WITH q AS (
  SELECT doc_id AS qa_id, CASE WHEN quality = 1 THEN [doc_id, doc_id + 1] WHEN toxic = 0 THEN [doc_id + 1000000000]
         ELSE CAST([] AS BIGINT[]) END AS ids
  FROM labels ORDER BY md5(CAST(doc_id AS VARCHAR) || '7'), doc_id LIMIT 25),
c AS (SELECT qa_id, unnest(ids) AS doc_id FROM q),
f AS (
  SELECT qa_id, string_agg('[Chunk ID: ' || doc_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id) AS t
  FROM c JOIN documents USING (doc_id) GROUP BY qa_id)
SELECT qa_id, md5(CASE WHEN len(ids) = 0 THEN 'No source chunk IDs provided in metadata.'
  WHEN t IS NULL THEN 'WARNING: Chunks with IDs [' || array_to_string(ids, ', ') || '] not found in rag_chunks collection.'
  ELSE t END) AS text_hash
FROM q LEFT JOIN f USING (qa_id)
""",
)
def sample_audit_join(spark, sf):
    me = F.col("doc_id")
    ids = (
        F.when(F.col("quality") == 1, F.array(me, me + 1))
        .when(F.col("toxic") == 0, F.array(me + 1_000_000_000))
        .otherwise(F.array().cast("array<bigint>"))
    )
    pairs = table(spark, sf, "labels").select(me.alias("qa_id"), ids.alias("source_chunk_ids"))
    audit = qna.sample_with_sources(
        pairs, _docs(spark, sf, "doc_id", "text"), "qa_id", "source_chunk_ids", "doc_id", "text", 25, "7"
    )
    return audit.select("qa_id", F.md5("source_text").alias("text_hash"))


@catalogue.add(
    "q34_group_category_complexity",
    """
WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'category' AS dimension, CAST(quality AS VARCHAR) AS value, count(*) AS n FROM d GROUP BY quality
UNION ALL SELECT 'complexity', CAST(toxic AS VARCHAR), count(*) FROM d GROUP BY toxic
""",
)
def group_category_complexity(spark, sf):
    rows = _docs(spark, sf, "doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return analyze.value_counts(rows, {"category": F.col("quality"), "complexity": F.col("toxic")})


@catalogue.add(
    "q35_distinct_flatten",
    r"""
WITH w AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM conversations)
SELECT (SELECT count(*) FROM conversations) AS total_qa_pairs, count(DISTINCT w) FILTER (w <> '') AS unique_source_chunks,
       (SELECT count(DISTINCT conv_id) FROM conversations) AS unique_batches
FROM w
""",
)
def distinct_flatten(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", words(F.col("text")).alias("ids"))
    return qna.qa_totals(turns, "ids", "conv_id")


@catalogue.add(
    "q36_array_size_histogram",
    r"""
SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS size, count(*) AS n
FROM conversations GROUP BY 1
""",
)
def array_size_histogram(spark, sf):
    return analyze.size_histogram(table(spark, sf, "conversations"), F.size(words(F.col("text"))))


@catalogue.add(
    "q41_abort_after_three",
    """
WITH e AS (
  SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS UNBOUNDED PRECEDING) AS r FROM events)
SELECT event_id, user_id, event_type, CAST(r AS BIGINT) AS failures FROM e WHERE r - f < 3
""",
)
def abort_after_three(spark, sf):
    runs = table(spark, sf, "events").select("event_id", "user_id", "event_type", event_micros().alias("micros"))
    kept = qna.until_abort(runs, ["user_id"], ["micros", "event_id"], F.col("event_type") == "error")
    return kept.select("event_id", "user_id", "event_type", "failures")


@catalogue.add(
    "q43_constraint_rejects",
    """
WITH q AS (
  SELECT d.doc_id, split_part(text, chr(10), 1) AS question, substring(text, 1, 60 - (n_chars % 40)::INTEGER) AS answer,
         substring(text, 5, (n_chars % 50)::INTEGER) AS quote,
         CASE lang WHEN 'en' THEN 'simple' WHEN 'fr' THEN 'expert' WHEN 'de' THEN 'hard' END AS complexity,
         l.doc_id IS NOT NULL AS cited
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, concat_ws(',', CASE WHEN length(question) < 10 THEN 'question' END,
         CASE WHEN length(answer) < 50 THEN 'answer' END, CASE WHEN length(quote) < 20 THEN 'evidence_quote' END,
         CASE WHEN NOT cited THEN 'source_chunk_ids' END,
         CASE WHEN coalesce(complexity NOT IN ('simple', 'moderate', 'complex', 'expert'), true) THEN 'complexity' END) AS faults
FROM q
""",
)
def constraint_rejects(spark, sf):
    docs = table(spark, sf, "documents").join(
        table(spark, sf, "labels").select("doc_id", F.lit(True).alias("cited")), "doc_id", "left"
    )
    text, lang = F.col("text"), F.col("lang")
    n = F.col("n_chars")
    faults = qna.constraint_faults(
        first_line(text),
        F.substring(text, F.lit(1), (60 - n % 40).cast("int")),
        F.substring(text, F.lit(5), (n % 50).cast("int")),
        F.when(lang == "en", "simple").when(lang == "fr", "expert").when(lang == "de", "hard"),
        F.when(F.col("cited"), F.array("doc_id")).otherwise(F.array().cast("array<bigint>")),
    )
    return docs.select("doc_id", F.array_join(faults, ",").alias("faults"))


@catalogue.add(
    "q52_group_by_book_list",
    f"""
WITH {_TUMBLING},
b AS (SELECT lang, rn // 3 AS i, list_sort(list(DISTINCT source)) AS books FROM m GROUP BY lang, rn // 3)
SELECT array_to_string(books, ',') AS included_books, count(*) AS n FROM b GROUP BY books
""",
)
def group_by_book_list(spark, sf):
    members = qna.tumbling_members(_docs(spark, sf, "doc_id", "lang", "source"), ["lang"], ["doc_id"], size=3)
    lists = members.groupBy("lang", "batch_index").agg(F.array_sort(F.collect_set("source")).alias("included_books"))
    counted = lists.groupBy("included_books").agg(F.count("*").alias("n"))
    return counted.select(F.array_join("included_books", ",").alias("included_books"), "n")


@catalogue.add(
    "q58_batch_prompt_text",
    """
WITH i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn FROM documents)
SELECT lang, rn // 10 AS batch_index, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY rn) AS chunk_ids,
       md5(string_agg('=== CHUNK_ID: ' || doc_id || ' ===' || chr(10) || '[Book: ' || source || ' | Chapter: Unknown]' || chr(10)
           || text || chr(10) || '=== END ' || doc_id || ' ===' || chr(10), chr(10) ORDER BY rn)) AS text_hash
FROM i GROUP BY lang, rn // 10
""",
)
def batch_prompt_text(spark, sf):
    members = qna.tumbling_members(_docs(spark, sf), ["lang"], ["doc_id"], size=10)
    texts = qna.batch_text(members, ["lang"], "doc_id", "text", style="evaluation", book=F.col("source"))
    return texts.select("lang", "batch_index", "chunk_ids", F.md5("batch_text").alias("text_hash"))


@catalogue.add(
    "q65_progress_counters",
    """
SELECT user_id, count(*) AS total_batches, count(*) FILTER (event_type <> 'error') AS processed_batches,
       count(*) FILTER (event_type = 'error') AS failed_batches,
       CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END) AS BIGINT)
         AS total_qa_pairs,
       max(CASE WHEN event_type <> 'error' THEN event_id END) AS last_processed
FROM events GROUP BY user_id
""",
)
def progress_counters(spark, sf):
    runs = table(spark, sf, "events")
    pairs = F.get_json_object("props", "$.k").cast("bigint")
    return qna.progress(runs, ["user_id"], ["event_id"], F.col("event_type") == "error", pairs)


@catalogue.add(
    "q69_pair_ids",
    """
WITH l AS (SELECT *, CASE quality WHEN 1 THEN 'characters' ELSE 'lore' END AS category FROM labels)
SELECT doc_id, printf('%s_%s_%04d', 'b' || toxic, category,
         row_number() OVER (PARTITION BY toxic, category ORDER BY doc_id) - 1) AS qa_id,
       printf('s_rag_eval_%04d_%04d', toxic, row_number() OVER (PARTITION BY toxic, category ORDER BY doc_id) - 1) AS eval_id,
       CASE category WHEN 'lore' THEN 'Lore & World-Building' ELSE 'Characters & Identities' END AS category_name
FROM l
""",
)
def pair_ids(spark, sf):
    pairs = table(spark, sf, "labels").withColumn(
        "category", F.when(F.col("quality") == 1, "characters").otherwise("lore")
    )
    numbered = qna.with_category_name(qna.number_pairs(pairs, ["toxic", "category"], ["doc_id"]))
    batch = F.concat(F.lit("b"), F.col("toxic").cast("string"))
    return numbered.select(
        "doc_id",
        qna.category_qa_id(batch, F.col("category"), F.col("pair_index")).alias("qa_id"),
        qna.evaluation_qa_id(F.lit("s"), F.col("toxic"), F.col("pair_index")).alias("eval_id"),
        "category_name",
    )
