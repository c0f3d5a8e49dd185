"""Dense, full-text and hybrid retrieval and its quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeweave.operators import fulltext, grounding, questions, retrieval
from tomeweave.plans.base import Catalogue, table
from tomeweave.scale import spread
from tomeweave.session import cut_lineage

catalogue = Catalogue()

_TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_QUERY_VECTOR = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_COSINE = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[]))"
_BM25 = f"""
q AS (SELECT DISTINCT unnest({_TERMS.format('text')}) AS term FROM benchmark
      WHERE item_id = (SELECT min(item_id) FROM benchmark)),
toks AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM toks),
flat AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score
       FROM tf JOIN df USING (term), st GROUP BY doc_id)
"""
_LEGS = f"""
{_BM25},
dv AS (SELECT vec_id AS doc_id, {_COSINE} AS score FROM embeddings),
dl AS (SELECT * FROM dv ORDER BY round(score, 9) DESC, doc_id LIMIT 20),
sl AS (SELECT doc_id, score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 20)
"""


def _query_vector(spark, sf):
    return table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def _query_text(spark, sf):
    return table(spark, sf, "benchmark").orderBy("item_id").select("text").first()[0]


def _rounded(df, digits=6):
    return df.withColumn("score", F.round("score", digits))


@catalogue.add(
    "q20_dense_topk",
    f"""
SELECT vec_id, label, round(score, 6) AS score
FROM (SELECT vec_id, label, {_COSINE} AS score FROM embeddings) ORDER BY round(score, 9) DESC, vec_id LIMIT 20
""",
)
def dense_topk(spark, sf):
    return _rounded(retrieval.dense_search(table(spark, sf, "embeddings"), _query_vector(spark, sf), id_col="vec_id"))


@catalogue.add(
    "q21_dense_topk_filtered",
    f"""
SELECT vec_id, label, round(score, 6) AS score
FROM (SELECT vec_id, label, {_COSINE} AS score FROM embeddings WHERE label = 3)
ORDER BY round(score, 9) DESC, vec_id LIMIT 20
""",
)
def dense_topk_filtered(spark, sf):
    found = retrieval.dense_search(
        table(spark, sf, "embeddings"), _query_vector(spark, sf), where=F.col("label") == 3, id_col="vec_id"
    )
    return _rounded(found)


_KNN = """
parts AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
means AS (SELECT label, i, avg(v) AS m FROM parts GROUP BY label, i),
cent AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM means GROUP BY label),
sc AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, cent),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sc)
"""


def _knn(spark, sf):
    vectors = table(spark, sf, "embeddings")
    queries = cut_lineage(retrieval.centroids(vectors, "label"), "centroids")
    return retrieval.dense_search_batch(vectors, queries, 10, id_col="vec_id")


@catalogue.add(
    "q22_knn_batch",
    f"WITH {_KNN} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM knn WHERE rank <= 10",
)
def knn_batch(spark, sf):
    return _rounded(_knn(spark, sf))


@catalogue.add(
    "q23_bm25_topk",
    f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 20",
)
def bm25_topk(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return _rounded(retrieval.bm25_search(docs, _query_text(spark, sf), id_col="doc_id"))


def _legs(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    dense = retrieval.dense_search(vectors, _query_vector(spark, sf), id_col="doc_id")
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return dense, retrieval.bm25_search(docs, _query_text(spark, sf), id_col="doc_id")


@catalogue.add(
    "q24_hybrid_weighted",
    f"""
WITH {_LEGS}
SELECT doc_id, round(s, 6) AS score FROM (
  SELECT coalesce(d.doc_id, s.doc_id) AS doc_id,
         0.7 * coalesce((1 + d.score) / 2, 0) + 0.3 * coalesce(2 / pi() * atan(s.score), 0) AS s
  FROM dl d FULL OUTER JOIN sl s ON d.doc_id = s.doc_id)
ORDER BY round(s, 9) DESC, doc_id LIMIT 20
""",
)
def hybrid_weighted(spark, sf):
    return _rounded(retrieval.fuse_weighted(*_legs(spark, sf), "doc_id"))


@catalogue.add(
    "q25_hybrid_rrf",
    f"""
WITH {_LEGS},
r AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM dl
      UNION ALL SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) FROM sl)
SELECT doc_id, round(sum(1.0 / (60 + r)), 6) AS score FROM r GROUP BY doc_id
ORDER BY round(sum(1.0 / (60 + r)), 9) DESC, doc_id LIMIT 20
""",
)
def hybrid_rrf(spark, sf):
    return _rounded(retrieval.fuse_ranks(*_legs(spark, sf), "doc_id"))


@catalogue.add(
    "q26_recall_precision_at_k",
    f"""
WITH {_KNN},
r AS (SELECT * FROM knn WHERE rank <= 10),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT query_id, count(*) FILTER (e.label = query_id) AS hits,
       round(count(*) FILTER (e.label = query_id) * 1.0 / max(n.n), 6) AS recall,
       round(count(*) FILTER (e.label = query_id) * 1.0 / count(*), 6) AS precision
FROM r JOIN embeddings e USING (vec_id) JOIN n ON n.label = query_id GROUP BY query_id
""",
)
def recall_precision_at_k(spark, sf):
    expected = table(spark, sf, "embeddings").select(F.col("label").alias("query_id"), "vec_id")
    scored = retrieval.quality_by_join(_knn(spark, sf), expected, "query_id", "vec_id")
    return scored.withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


@catalogue.add(
    "q27_evidence_grounding",
    "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
)
def evidence_grounding(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    quotes = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    return grounding.find_quotes(docs, quotes, "doc_id", "text", "item_id", "quote")


@catalogue.add(
    "q60_bm25_postings",
    f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 20",
)
def bm25_postings(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    size = docs.select(F.size(retrieval.terms(F.col("text"))).alias("n")).agg(F.count("*"), F.avg("n")).first()
    buckets, shards = retrieval.index_layout(size[0])
    index = retrieval.write_postings(retrieval.postings(docs, "doc_id", "text", buckets), "postings", shards, None, size[0], buckets)
    found = retrieval.search_postings(index, size[0], size[1], _query_text(spark, sf), "doc_id")
    return _rounded(found)


@catalogue.add(
    "q67_evidence_in_sources",
    """
SELECT d.doc_id, coalesce(bool_or(contains(s.text, substring(d.text, 11, 40))), false) AS grounded
FROM documents d LEFT JOIN documents s ON s.doc_id = d.doc_id + (CASE WHEN d.lang = 'en' THEN 0 ELSE 1 END)
      OR s.doc_id = d.doc_id + 2
GROUP BY d.doc_id
""",
)
def evidence_in_sources(spark, sf):
    docs = table(spark, sf, "documents")
    own = F.when(F.col("lang") == "en", F.col("doc_id")).otherwise(F.col("doc_id") + 1)
    qa = docs.select(
        F.col("doc_id").alias("qa_id"),
        F.substring("text", 11, 40).alias("evidence_quote"),
        F.array(own, F.col("doc_id") + 2).alias("source_chunk_ids"),
    )
    checked = grounding.quotes_in_sources(
        qa, docs, "qa_id", "evidence_quote", "source_chunk_ids", "doc_id", "text"
    )
    return checked.select(F.col("qa_id").alias("doc_id"), "grounded")


@catalogue.add(
    "q75_array_quality",
    """
WITH a AS (SELECT doc_id, [doc_id, doc_id + 1, n_chars % 7] AS got, [doc_id + 1, n_chars % 5] AS want FROM documents)
SELECT doc_id, round(len(list_intersect(got, want)) * 1.0 / len(list_distinct(want)), 6) AS recall,
       round(len(list_intersect(got, want)) * 1.0 / len(list_distinct(got)), 6) AS precision
FROM a
""",
)
def array_quality(spark, sf):
    me, n = F.col("doc_id"), F.col("n_chars")
    rows = table(spark, sf, "documents").select(
        "doc_id", F.array(me, me + 1, n % 7).alias("got"), F.array(me + 1, n % 5).alias("want")
    )
    scored = retrieval.quality(rows, "got", "want")
    return scored.select("doc_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


# ------------------------------------------------------- tables of questions
_ASKED = f"""
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
toks AS (SELECT doc_id, lang, {_TERMS.format('text')} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM toks),
flat AS (SELECT doc_id, lang, len(t) AS dl, unnest(t) AS term FROM toks),
tf AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score
       FROM q JOIN tf USING (term) JOIN df USING (term), st WHERE lang = 'en' GROUP BY ALL),
sl AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm
       QUALIFY rank <= 10),
qv AS (SELECT item_id, CAST(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
dv AS (SELECT item_id, vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score FROM embeddings, qv)
"""


def _asked(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector"))
    return table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query_text")).join(vectors, "item_id", "left")


def _index(spark, sf):
    return fulltext.scratch_index(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id", carry=("lang",))


@catalogue.add(
    "q82_fulltext_questions",
    f"WITH {_ASKED} SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM sl",
)
def fulltext_questions(spark, sf):
    return _rounded(fulltext.search(_index(spark, sf), _asked(spark, sf), 10, F.col("lang") == "en", "item_id"))


@catalogue.add(
    "q83_hybrid_questions",
    f"""
WITH {_ASKED},
dl AS (SELECT item_id, d.doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, d.doc_id) AS rank
       FROM dv d JOIN documents USING (doc_id) WHERE lang = 'en' QUALIFY rank <= 10),
parts AS (SELECT item_id, doc_id, 0.7 * (1 + score) / 2 AS s FROM dl UNION ALL SELECT item_id, doc_id, 0.6 / pi() * atan(score) FROM sl),
fused AS (SELECT item_id, doc_id, sum(s) AS score FROM parts GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank
FROM fused QUALIFY rank <= 10
""",
)
def hybrid_questions(spark, sf):
    languages = table(spark, sf, "documents").select("doc_id", "lang")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(languages, "doc_id")
    return _rounded(fulltext.hybrid(_index(spark, sf), vectors, _asked(spark, sf), 10, F.col("lang") == "en", "item_id"))


_KEY = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@catalogue.add(
    "q84_graph_questions",
    f"""
WITH {_ASKED},
said AS (SELECT DISTINCT item_id, {_KEY.format('x')} AS key FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS x FROM benchmark)),
names AS (SELECT DISTINCT 'doc_' || doc_id AS id, {_KEY.format('x')} AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
h0 AS (SELECT DISTINCT item_id, id, 0 AS hop, id AS path FROM said JOIN names USING (key) WHERE key <> ''),
e AS (SELECT 'doc_' || doc_id AS a, 'doc_' || (doc_id - 1) AS b FROM documents UNION SELECT 'doc_' || doc_id, source FROM documents WHERE source IS NOT NULL),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
h1 AS (SELECT item_id, b AS id, 1 AS hop, min(path || ' > ' || b) AS path FROM h0 JOIN both_ways ON a = id
       WHERE (item_id, b) NOT IN (SELECT (item_id, id) FROM h0) GROUP BY ALL),
r1 AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1),
h2 AS (SELECT item_id, b AS id, 2 AS hop, min(path || ' > ' || b) AS path FROM h1 JOIN both_ways ON a = id
       WHERE (item_id, b) NOT IN (SELECT (item_id, id) FROM r1) GROUP BY ALL),
r2 AS (SELECT * FROM r1 UNION ALL SELECT * FROM h2),
m AS (SELECT 'doc_' || doc_id AS id, doc_id FROM documents UNION SELECT 'doc_' || (doc_id + 1), doc_id FROM documents),
near AS (SELECT item_id, doc_id, min(hop) AS hop, count(*) AS n, first(path ORDER BY hop, path) AS path FROM r2 JOIN m USING (id) GROUP BY ALL),
g AS (SELECT item_id, doc_id, hop, path, row_number() OVER (PARTITION BY item_id ORDER BY hop, n DESC, doc_id) AS rank FROM near QUALIFY rank <= 10),
d AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank
      FROM dv WHERE item_id NOT IN (SELECT item_id FROM g) QUALIFY rank <= 10)
SELECT item_id, 'graph' AS leg, rank::INT AS rank, doc_id, hop, path, NULL::DOUBLE AS score FROM g
UNION ALL SELECT item_id, 'dense', rank::INT, doc_id, NULL, NULL, round(score, 6) FROM d
""",
)
def graph_questions(spark, sf):
    docs = table(spark, sf, "documents")
    me = lambda shift=0: F.concat(F.lit("doc_"), (F.col("doc_id") + shift).cast("string"))
    aliases = docs.select(me().alias("entity"), F.explode(F.split("text", "\n")).alias("alias"))
    edges = docs.select(me().alias("src"), me(-1).alias("dst")).unionByName(docs.select(me().alias("src"), F.col("source").alias("dst")))
    # A document tells of itself and of the one after it.
    mentions = docs.select(me().alias("entity"), "doc_id").unionByName(docs.select(me(1).alias("entity"), "doc_id"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = _asked(spark, sf)
    found = questions.answer(
        asked, F.split("query_text", "\n"), aliases, edges, mentions, vectors, 2, 10, "item_id", "query_vector", "entity", "doc_id",
    )
    return _rounded(found)
