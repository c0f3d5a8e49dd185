"""The registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import alignment, decontaminate, langid, licenses, nbsvm, pii, quality, secrets, sentencepieces, simhash, urlfilter, warc, whitening
from tomeweave.plans.base import Catalogue, table
from tomeweave.session import scratch_path

catalogue = Catalogue()

#: Host and path rules of the URL filter, in order.
HOST_RULES = (
    urlfilter.host_rule("allow", "com/"),
    urlfilter.host_rule("block", "example.com/en/"),
    urlfilter.host_rule("allow", "www.example.com/en/"),
    urlfilter.host_rule("block", "net/es/"),
    urlfilter.host_rule("block", "net/fr/"),
)


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# -------------------------------------------------------------------- op1
@catalogue.add(
    "op1_decontamination",
    f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bw),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
occ AS (SELECT doc_id, k, i, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM pos) JOIN win USING (k, s)),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM occ) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


# -------------------------------------------------------------------- op2
@catalogue.add("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the base is tested against another regular-expression engine, terms on a small corpus."""
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.number_of("base", k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.concat("base", "terms")).alias("spans")
    )


# -------------------------------------------------------------------- op3
@catalogue.add("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document; tested against brute-force containment (band keys are not in SQL)."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"])))
    spans = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"]))
    return found.select("doc_id", F.size("found").cast("bigint").alias("n_found"), F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))


# -------------------------------------------------------------------- op4
_WORD = "[^\\x20\\x09-\\x0D]+"
_TERM = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
_PART = f"({_TERM.format(x='{p}', p='{p}', q='{q}')} + {_TERM.format(x='{q}', p='{p}', q='{q}')}) / 2"


@catalogue.add(
    "op4_quality_rules",
    f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
each AS (SELECT doc_id, lang, len(w) AS n_words, length(t) AS n, length(array_to_string(w, '')) AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS c0, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS c1,
                length(regexp_replace(t, '[^0-9]+', '', 'g')) AS c2, strlen(t) - length(t) AS c3,
                len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) AS n_lines,
                len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) AS n_other FROM d),
full_ AS (SELECT *, greatest(0, n - (c0 + c1 + c2 + c3)) AS c4 FROM each),
sums AS (SELECT coalesce(lang, '') AS k, sum(c0) AS s0, sum(c1) AS s1, sum(c2) AS s2, sum(c3) AS s3, sum(c4) AS s4, sum(n_words) AS words
         FROM (SELECT lang, c0, c1, c2, c3, c4, n_words FROM full_ WHERE lang IS NOT NULL
               UNION ALL SELECT '', c0, c1, c2, c3, c4, n_words FROM full_) GROUP BY 1),
flat AS (SELECT doc_id, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
short AS (SELECT lang AS k, x FROM flat WHERE length(x) <= 4 AND regexp_matches(x, '^\\pL+$') AND lang IS NOT NULL
          UNION ALL SELECT '', x FROM flat WHERE length(x) <= 4 AND regexp_matches(x, '^\\pL+$')),
ranked AS (SELECT k, x, count(*) AS c, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, x) AS r FROM short GROUP BY k, x),
common AS (SELECT k, x, c / words AS q FROM ranked JOIN sums USING (k) WHERE r <= 16),
lack AS (SELECT k, covered, bins, (full_cover + log2(2 / (2 - full_cover))
                + (1 - full_cover) * log2(CASE WHEN full_cover < 1 THEN 2 * (1 - full_cover) / (2 - full_cover) ELSE 1 END)) / 2 AS lacking
         FROM (SELECT k, sum(q) AS covered, least(1, sum(q)) AS full_cover, count(*) AS bins FROM common GROUP BY k)),
counted AS (SELECT doc_id, x, count(*) AS c FROM flat GROUP BY ALL),
pq AS (SELECT f.doc_id, f.n_words, coalesce(c.c, 0) / greatest(1, f.n_words) AS p, m.q
       FROM full_ f JOIN common m ON m.k = coalesce(f.lang, '') LEFT JOIN counted c ON c.doc_id = f.doc_id AND c.x = m.x),
pq_all AS (SELECT doc_id, p, q FROM pq
           UNION ALL SELECT doc_id, 1 - sum(p), greatest(0, 1 - sum(q)) FROM pq GROUP BY doc_id),
word_js AS (SELECT doc_id, sqrt(greatest(0, sum({_PART.format(p="p", q="q")}))) AS j FROM pq_all GROUP BY doc_id),
cpq AS (SELECT doc_id, unnest([c0, c1, c2, c3, c4]) / greatest(1, c0 + c1 + c2 + c3 + c4) AS p,
               unnest([s0, s1, s2, s3, s4]) / greatest(1, s0 + s1 + s2 + s3 + s4) AS q FROM full_ JOIN sums ON k = coalesce(lang, '')),
char_js AS (SELECT doc_id, sqrt(greatest(0, sum({_PART.format(p="p", q="q")}))) AS j FROM cpq GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM win JOIN (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, s)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY 1),
base AS (SELECT f.*, coalesce(rep.n, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(rep.n, 0) > 30 * n_words AS base_failed
         FROM full_ f LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, c0::BIGINT AS n_symbols,
       (n_lines - n_other)::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (n < 200 OR char_js.j <= 0.31) AND (n_words < 60 OR coalesce(word_js.j, 0) <= coalesce(CASE
         WHEN n_words * covered >= 8 THEN least(0.42, sqrt(least(0.9025 * lacking, greatest(0.36 * lacking, (bins + 4.5 * sqrt(2 * bins)) / (8 * ln(2) * n_words)))))
         WHEN covered IS NOT NULL THEN 0.42 END, 1)) AS kept
FROM base LEFT JOIN char_js USING (doc_id) LEFT JOIN word_js USING (doc_id) LEFT JOIN lack ON lack.k = coalesce(lang, '')""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


# -------------------------------------------------------------------- op5
@catalogue.add("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document; tested against brute force (XXH64 is not in SQL)."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -------------------------------------------------------------------- op6
_WORDS = " OR ".join(
    f"regexp_matches(lower(host || path), '(^|[^a-z0-9]){'-'.join(w)}($|[^a-z0-9])')" for w in urlfilter.BLOCKED_WORDS
)


@catalogue.add(
    "op6_url_filter",
    f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fit AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN {_WORDS} THEN 'block' ELSE 'allow' END AS verdict
FROM fit""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), HOST_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# -------------------------------------------------------------------- op7
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, 1 + 10 * i, 10))::BIGINT >> (35 - 5 * j)) & 31)::INT + 1, 1)"


@catalogue.add(
    "op7_warc_archive",
    f"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
named AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM rows)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: {_LETTER.replace("* i", "* (k // 8)").replace("* j", "* (k % 8)")}), '')
         AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM named""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.index(spark, path)


# -------------------------------------------------------------------- op8
@catalogue.add("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and secrets of every document; tested on planted secrets and look-alikes (a forest is not in SQL)."""
    docs = table(spark, sf_dir, "documents")
    forest, dictionary = secrets.prepared(docs)
    found = secrets.scan(docs, forest, dictionary)
    spans = F.array_join(F.transform("secrets", lambda c: F.concat_ws(":", c["start"], c["end"])), ",")
    return found.select(
        "doc_id", F.size("candidates").cast("bigint").alias("n_candidates"), F.size("secrets").cast("bigint").alias("n_secrets"), spans.alias("spans")
    )


# -------------------------------------------------------------------- op9
VOCABULARY = os.environ.get("TOMEWEAVE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


@catalogue.add("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, decoded again; tested against brute force and by the round trip (Viterbi is not in SQL)."""
    vocab = sentencepieces.load(VOCABULARY)
    pieces = sentencepieces.encode(table(spark, sf_dir, "documents"), vocab, keep=("text",))
    back = sentencepieces.decode(pieces, vocab)
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("pieces_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


# -------------------------------------------------------------------- op10
@catalogue.add("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; tested by held-out accuracy (a trained network is not in SQL)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# -------------------------------------------------------------------- op11
BYTE_LEVEL = os.environ.get("TOMEWEAVE_BYTE_LEVEL", "/opt/tokenizers/byte_bpe_50k.json")


@catalogue.add("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned groups and links of every document; tested against loops over whole texts (tokenizers are not in SQL)."""
    return alignment.align(alignment.link(table(spark, sf_dir, "documents"), BYTE_LEVEL, VOCABULARY))


# -------------------------------------------------------------------- op12
@catalogue.add("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding; tested against loops over fractions (eigenvectors are not in SQL)."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


# -------------------------------------------------------------------- op13
@catalogue.add("op13_quality_classifier")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; tested by held-out accuracy and against plain loops (a fitted model is not in SQL)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = nbsvm.predict(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = dict(catalogue.queries)
SQL = dict(catalogue.sql)
