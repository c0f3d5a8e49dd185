"""Text, chunking, packing and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeweave.constants import UNKNOWN
from tomeweave.functions import chapters, jsonfields
from tomeweave.functions import text as tx
from tomeweave.operators import analyze, chunking, packing
from tomeweave.plans.base import Catalogue, first_line, table
from tomeweave.scale import row_index, spread

catalogue = Catalogue()

# DuckDB's trim() with the whitespace that occurs in the tables.
_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _labelled(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").withColumns(
        {
            "chapter_number": F.coalesce(F.col("quality").cast("string"), F.lit(UNKNOWN)),
            "chapter_title": F.coalesce(F.col("toxic").cast("string"), F.lit(UNKNOWN)),
        }
    )


_LABELLED_SQL = """
    SELECT d.*, coalesce(CAST(quality AS VARCHAR), 'N/A') AS chapter_number,
           coalesce(CAST(toxic AS VARCHAR), 'N/A') AS chapter_title, quality, toxic
    FROM documents d LEFT JOIN labels l USING (doc_id)
"""


@catalogue.add(
    "q01_chunk_stats",
    f"""
WITH d AS ({_LABELLED_SQL})
SELECT count(*) AS total_chunks, round(avg(length(text)), 6) AS avg_size,
       CAST(max(length(text)) AS BIGINT) AS max_size, CAST(min(length(text)) AS BIGINT) AS min_size,
       CAST(count(*) FILTER (chapter_number = 'N/A' AND chapter_title = 'N/A') AS BIGINT) AS na_chapters,
       round(count(*) FILTER (chapter_number = 'N/A' AND chapter_title = 'N/A') * 100.0 / count(*), 1) AS na_percentage
FROM d
""",
)
def chunk_stats(spark, sf):
    return analyze.summary(_labelled(spark, sf), F.length("text"))


@catalogue.add(
    "q02_source_distribution",
    f"""
WITH d AS ({_LABELLED_SQL})
SELECT source, count(*) AS chunks, count(DISTINCT (lang, chapter_number)) AS unique_chapters
FROM d GROUP BY source
""",
)
def source_distribution(spark, sf):
    return analyze.book_distribution(_labelled(spark, sf), "source", "lang", "chapter_number")


@catalogue.add(
    "q04_fixed_stride_chunks",
    """
WITH c AS (SELECT doc_id, lang, text, unnest(range(1, length(text) + 1, 3200)) AS s FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, s) - 1 AS rn FROM c)
SELECT printf('%s_rag_%05d', lang, rn) AS chunk_id, doc_id, CAST((s - 1) // 3200 AS INTEGER) AS chunk_index,
       CAST(length(substring(text, s, 4000)) AS BIGINT) AS character_count, md5(substring(text, s, 4000)) AS text_hash
FROM n
""",
)
def fixed_stride_chunks(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    numbered = chunking.stride_rag_chunks(docs, "lang", "doc_id")
    return numbered.select(
        "chunk_id",
        "doc_id",
        "chunk_index",
        F.length("chunk_text").cast("bigint").alias("character_count"),
        tx.content_hash(F.col("chunk_text")).alias("text_hash"),
    )


@catalogue.add(
    "q05_paragraph_split",
    f"""
WITH p AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS part_index,
         trim(unnest(string_split(text, chr(10))), {_WS}) AS part
  FROM documents)
SELECT doc_id, CAST(part_index AS INTEGER) AS part_index, length(part) AS n_chars, md5(part) AS part_hash
FROM p WHERE length(part) > 0
""",
)
def paragraph_split(spark, sf):
    parts = chunking.paragraphs(spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"))
    return parts.select(
        "doc_id", "part_index", F.length("part").cast("bigint").alias("n_chars"), F.md5("part").alias("part_hash")
    )


@catalogue.add(
    "q06_title_false_positive",
    """
WITH c AS (
  SELECT doc_id, CASE n_chars % 5 WHEN 0 THEN ' Image ' WHEN 1 THEN source || '.JPG'
           WHEN 2 THEN 'Books  by ' || split_part(text, chr(10), 1) WHEN 3 THEN 'Table of' || chr(9) || 'Contents'
           ELSE split_part(text, chr(10), 1) END AS title,
         CASE n_chars % 3 WHEN 0 THEN ' jon ' WHEN 1 THEN 'Sansa' ELSE lang END AS pov
  FROM documents)
SELECT doc_id, title, n AS is_false, upper(trim(pov)) IN ('JON', 'SANSA') AS is_pov
FROM (SELECT *, regexp_matches(trim(title), '(?i)^(image\\s*$|[a-z0-9_]+\\.jpg\\s*$|books\\s+by\\s+|table\\s+of\\s+contents\\s*$)') AS n FROM c)
""",
)
def title_false_positive(spark, sf):
    docs = table(spark, sf, "documents")
    line = first_line(F.col("text"))
    kind = F.col("n_chars") % 5
    title = (
        F.when(kind == 0, " Image ")
        .when(kind == 1, F.concat("source", F.lit(".JPG")))
        .when(kind == 2, F.concat(F.lit("Books  by "), line))
        .when(kind == 3, "Table of\tContents")
        .otherwise(line)
    )
    pov = F.when(F.col("n_chars") % 3 == 0, " jon ").when(F.col("n_chars") % 3 == 1, "Sansa").otherwise(F.col("lang"))
    return docs.select("doc_id", title.alias("title"), pov.alias("_pov")).select(
        "doc_id",
        "title",
        chapters.is_false_title(F.col("title")).alias("is_false"),
        chapters.is_pov_name(F.col("_pov")).alias("is_pov"),
    )


@catalogue.add(
    "q07_html_text_extract",
    r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?is)<script[^>]*>.*?</script>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(t, '(?s)<[^>]*>', ' ', 'g') AS t FROM c),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
             '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM d),
f AS (SELECT page_id, trim(regexp_replace(t, '[ \t\r\n]+', ' ', 'g')) AS t FROM e)
SELECT page_id, length(t) AS n_chars, md5(t) AS text_hash FROM f
""",
)
def html_text_extract(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", tx.html_to_text(F.col("html")).alias("t")).select(
        "page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("text_hash")
    )


@catalogue.add(
    "q08_header_regex_groups",
    """
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
       regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
       regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading FROM pages
""",
)
def header_regex_groups(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(html, "(?s)<h1>(.*?)</h1>", 1).alias("heading"),
    )


@catalogue.add(
    "q09_forward_fill",
    """
WITH h AS (
  SELECT conv_id, turn, CASE WHEN role IN ('assistant', 'system') THEN CAST(turn AS VARCHAR) END AS n,
         CASE WHEN role = 'assistant' THEN role WHEN role = 'system' THEN 'N/A' END AS t FROM conversations)
SELECT conv_id, turn,
       coalesce(last_value(n IGNORE NULLS) OVER w, 'N/A') AS chapter_number,
       coalesce(last_value(t IGNORE NULLS) OVER w, 'N/A') AS chapter_title
FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
)
def forward_fill(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    title = F.when(F.col("role") == "assistant", F.col("role")).otherwise(UNKNOWN)
    found = F.when(
        F.col("role").isin("assistant", "system"),
        F.struct(F.col("turn").cast("string").alias("number"), title.alias("title")),
    )
    filled = chunking.fill_chapters(turns, found, ["conv_id"], ["turn"])
    return filled.select("conv_id", "turn", "chapter_number", "chapter_title")


@catalogue.add(
    "q10_budget_pack",
    """
WITH RECURSIVE o AS (
  SELECT source, doc_id, n_chars AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
f AS (
  SELECT source, doc_id, rn, c AS s, CAST(1 AS BIGINT) AS section FROM o WHERE rn = 1
  UNION ALL
  SELECT o.source, o.doc_id, o.rn, CASE WHEN f.s + o.c > 20000 THEN o.c ELSE f.s + o.c END,
         CASE WHEN f.s + o.c > 20000 THEN f.section + 1 ELSE f.section END
  FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1)
SELECT source, doc_id, section FROM f
""",
)
def budget_pack(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return packing.pack(docs, ["source"], "doc_id", F.col("n_chars"), 20_000)


@catalogue.add(
    "q11_budget_pack_splitter",
    """
WITH RECURSIVE d AS (
  SELECT source, doc_id, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE length(text) > 0),
p AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS p
  FROM d WHERE t > 1500),
pc AS (SELECT doc_id, i, p, CAST(ceil(length(p) / 4.0) AS BIGINT) + 1 AS c FROM p),
pf AS (
  SELECT doc_id, i, p, c AS s, CASE WHEN c > 1500 THEN 1 ELSE 0 END AS part FROM pc WHERE i = 0
  UNION ALL
  SELECT pc.doc_id, pc.i, pc.p, CASE WHEN pf.s + pc.c > 1500 THEN pc.c ELSE pf.s + pc.c END,
         CASE WHEN pf.s + pc.c > 1500 THEN pf.part + 1 ELSE pf.part END
  FROM pf JOIN pc ON pc.doc_id = pf.doc_id AND pc.i = pf.i + 1),
b AS (SELECT doc_id, max(part) + 1 AS burst FROM pf GROUP BY doc_id),
o AS (SELECT d.*, b.burst FROM d LEFT JOIN b USING (doc_id)),
f AS (
  SELECT source, doc_id, rn, text, burst, CAST(1 AS BIGINT) AS label,
         CASE WHEN burst IS NULL THEN 1 ELSE 1 + burst END AS num, CASE WHEN burst IS NULL THEN t ELSE 0 END AS s
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.source, o.doc_id, o.rn, o.text, o.burst,
         CASE WHEN o.burst IS NOT NULL THEN f.num + (CASE WHEN f.s > 0 THEN 1 ELSE 0 END)
              WHEN f.s + o.t > 1500 THEN f.num + 1 ELSE f.num END,
         CASE WHEN o.burst IS NOT NULL THEN f.num + (CASE WHEN f.s > 0 THEN 1 ELSE 0 END) + o.burst
              WHEN f.s + o.t > 1500 THEN f.num + 1 ELSE f.num END,
         CASE WHEN o.burst IS NOT NULL THEN 0 WHEN f.s + o.t > 1500 THEN o.t ELSE f.s + o.t END
  FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1),
whole AS (
  SELECT source, label AS section, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS x,
         string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS books
  FROM f WHERE burst IS NULL GROUP BY ALL),
own AS (
  SELECT f.source, f.label + pf.part AS section, string_agg(pf.p, chr(10) ORDER BY pf.i) || chr(10) AS x,
         CAST(f.doc_id AS VARCHAR) AS books
  FROM f JOIN pf USING (doc_id) GROUP BY f.source, f.label, pf.part, f.doc_id),
u AS (SELECT * FROM whole UNION ALL SELECT * FROM own)
SELECT printf('%s_section_%02d', source, section) AS chunk_id, CAST(ceil(length(x) / 4.0) AS BIGINT) AS token_count,
       length(x) AS character_count, books AS included_books, md5(x) AS text_hash
FROM u WHERE length(trim(x, ' ' || chr(9) || chr(10) || chr(13))) > 0
""",
)
def budget_pack_splitter(spark, sf):
    docs = spread(table(spark, sf, "documents").select("source", "doc_id", "text"), "doc_id").withColumn(
        "book", F.col("doc_id").cast("string")
    )
    packed = packing.sections(docs, "source", "doc_id", "book", 1_500, separator="\n")
    return packed.select(
        "chunk_id",
        "token_count",
        "character_count",
        F.array_join("included_books", ",").alias("included_books"),
        F.md5("text_content").alias("text_hash"),
    )


@catalogue.add("q12_recursive_split")
def recursive_split(spark, sf):
    chunks = chunking.recursive_chunks(spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"))
    return chunks.select(
        "doc_id",
        "chunk_index",
        F.length("chunk_text").cast("bigint").alias("character_count"),
        F.md5("chunk_text").alias("text_hash"),
    )


@catalogue.add(
    "q13_word_token_estimates",
    r"""
SELECT source, count(*) AS n_docs,
       CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS n_words,
       CAST(sum(length(text)) // 4 AS BIGINT) AS estimated_tokens,
       CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS token_count
FROM documents GROUP BY source
""",
)
def word_token_estimates(spark, sf):
    text = F.col("text")
    return (
        spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
        .groupBy("source")
        .agg(
            F.count("*").alias("n_docs"),
            F.sum(tx.word_count(text)).alias("n_words"),
            F.floor(F.sum(F.length(text)) / 4).cast("bigint").alias("estimated_tokens"),
            F.sum(tx.token_estimate(text)).alias("token_count"),
        )
    )


@catalogue.add(
    "q14_slug_ids",
    """
SELECT doc_id, printf('%s_rag_%05d', replace(lower('The ' || source || ' ' || upper(lang)), ' ', '_'),
         row_number() OVER (ORDER BY doc_id) - 1) AS chunk_id,
       'cache_' || translate('vendor/' || source || '-2', '/-', '__') AS cache_name
FROM documents
""",
)
def slug_ids(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    name = F.concat_ws(" ", F.lit("The"), F.col("source"), F.upper("lang"))
    return row_index(docs, [], ["doc_id"]).select(
        "doc_id",
        tx.padded_id("%s_rag_%05d", tx.slugify(name), F.col("row_index")).alias("chunk_id"),
        F.concat(
            F.lit("cache_"), tx.model_slug(F.concat(F.lit("vendor/"), F.col("source"), F.lit("-2")))
        ).alias("cache_name"),
    )


@catalogue.add(
    "q37_distinct_tuples_sorted",
    f"WITH d AS ({_LABELLED_SQL}) SELECT DISTINCT lang, source, chapter_number, chapter_title FROM d",
)
def distinct_tuples_sorted(spark, sf):
    return (
        _labelled(spark, sf)
        .select("lang", "source", "chapter_number", "chapter_title")
        .distinct()
        .orderBy("lang", "source", "chapter_number", "chapter_title")
    )


@catalogue.add(
    "q44_json_parse_fallback",
    """
WITH v AS (
  SELECT event_id, CASE user_id % 4 WHEN 0 THEN props WHEN 1 THEN 'text ' || props WHEN 2 THEN '{bad' || props END AS raw
  FROM events)
SELECT event_id, CASE WHEN raw IS NULL THEN 'null' WHEN NOT starts_with(trim(raw), '{') THEN 'string'
         WHEN json_valid(raw) THEN 'object' ELSE 'invalid' END AS status,
       CASE WHEN starts_with(trim(raw), '{') AND json_valid(raw)
            THEN CAST(json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.k') AS BIGINT) END AS k,
       raw AS kept
FROM v
""",
)
def json_parse_fallback(spark, sf):
    kind = F.col("user_id") % 4
    raw = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.concat(F.lit("text "), F.col("props")))
        .when(kind == 2, F.concat(F.lit("{bad"), F.col("props")))
    )
    values = table(spark, sf, "events").select("event_id", raw.alias("kept"))
    return values.select(
        "event_id",
        jsonfields.parse_status(F.col("kept")).alias("status"),
        F.try_variant_get(jsonfields.parsed_object(F.col("kept")), "$.k", "bigint").alias("k"),
        "kept",
    )


@catalogue.add(
    "q51_chapter_headers",
    f"""
SELECT doc_id, lang,
       CASE lang WHEN 'de' THEN 'POV' WHEN 'fr' THEN 'Seven' ELSE CAST(doc_id AS VARCHAR) END AS chapter_number,
       CASE lang WHEN 'de' THEN 'TYRION' WHEN 'es' THEN 'N/A'
            ELSE trim(regexp_extract(text, '[^\\n]+'), {_WS}) END AS chapter_title
FROM documents
""",
)
def chapter_headers(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    lang, text = F.col("lang"), F.col("text")
    number = F.col("doc_id").cast("string")
    headed = docs.select(
        "doc_id",
        "lang",
        F.when(lang == "fr", F.concat(F.lit("Chapter Seven \n"), text))
        .when(lang == "de", F.concat(F.lit("  Tyrion \n"), text))
        .when(lang == "es", F.concat(F.lit("see chapter "), number, F.lit("\n"), text))
        .otherwise(F.concat(F.lit("CHAPTER "), number, F.lit("\n\n"), text))
        .alias("text"),
    )
    found = (
        F.when(lang == "fr", chapters.detect_chapter(text, "Harry Potter"))
        .when(lang == "de", chapters.detect_chapter(text, "Song of Ice and Fire"))
        .when(lang == "es", chapters.detect_chapter(text, "Some Other Series"))
        .otherwise(chapters.detect_chapter(text, "Wheel of Time"))
    )
    return headed.withColumn("c", found).select(
        "doc_id",
        "lang",
        F.coalesce("c.number", F.lit(UNKNOWN)).alias("chapter_number"),
        F.coalesce("c.title", F.lit(UNKNOWN)).alias("chapter_title"),
    )


@catalogue.add(
    "q62_scalar_functions",
    """
SELECT doc_id, replace(substring(text, 1, 200), chr(10), ' ') AS content_preview,
       CASE WHEN length(source) > 4 THEN '...' || right(source, 4) ELSE '***' END AS masked,
       coalesce(nullif(CASE WHEN lang = 'en' THEN '' WHEN lang = 'fr' THEN NULL ELSE lang END, ''), source) AS book
FROM documents
""",
)
def scalar_functions(spark, sf):
    own = F.when(F.col("lang") == "en", "").when(F.col("lang") != "fr", F.col("lang"))
    return table(spark, sf, "documents").select(
        "doc_id",
        tx.preview(F.col("text")).alias("content_preview"),
        tx.mask_key(F.col("source")).alias("masked"),
        tx.or_default(own, F.col("source")).alias("book"),
    )


@catalogue.add(
    "q63_head_sample",
    """
SELECT doc_id, replace(substring(text, 1, 200), chr(10), ' ') AS content_preview
FROM documents ORDER BY doc_id LIMIT 3
""",
)
def head_sample(spark, sf):
    return analyze.sample_chunks(table(spark, sf, "documents"), ["doc_id"], "text")
