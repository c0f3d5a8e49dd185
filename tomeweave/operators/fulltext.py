"""Full-text and hybrid search for a whole table of questions over a stored index.

The index is built once: postings laid out by document shard and term bucket,
each with the document's length and the columns a filter may name, and the
collection's statistics beside them. Questions are rows too, so no job runs per
question; a term's list is cut into shards, so a very common term is many keys
of the join instead of one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeweave.constants import BM25_B, BM25_K1, DENSE_WEIGHT, RRF_K, SPARSE_WEIGHT, TOP_K
from tomeweave.functions.text import terms
from tomeweave.operators.retrieval import by_bucket, dense_search_batch, flat_terms, index_layout, repeated_ids, term_counts
from tomeweave.session import cut_lineage, scratch_path

DIGITS = 9  # scores are compared to so many decimals, so that the order of summing decides no tie


@dataclass(frozen=True)
class Index:
    """A stored index: ``postings`` (id, doc_length, filter columns, term, tf, impact), ``vocabulary`` (term_bucket, term, df, top) and statistics."""

    postings: DataFrame
    vocabulary: DataFrame
    n_docs: int
    mean_length: float
    shards: int
    id_col: str


def build(docs: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> Index:
    """Write an index of ``docs`` below ``path`` and open it; ``carry`` names the columns that a search may filter by.

    The texts are read and tokenised once. ``impact`` is a posting's share of the
    score before the term's weight, so that it needs not be computed per question.
    """
    spark = docs.sparkSession
    length = F.greatest(F.coalesce("doc_length", F.lit(0)), F.lit(0)).cast("bigint")
    counted = cut_lineage(term_counts(docs, id_col, text_col, carry).withColumn("doc_length", length), "terms")
    repeated = repeated_ids(counted, id_col)
    sizes = counted.select(id_col, *carry, "doc_length")
    n_docs, mean = (sizes if repeated is None else sizes.distinct()).agg(F.count("*"), F.avg("doc_length")).first()
    buckets, shards = index_layout(n_docs)
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("doc_length") / F.lit(mean or 1.0))
    tf = F.col("tf").cast("double")
    # What follows from the other columns is not shuffled.
    bucket, shard = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")
    dealt = by_bucket(flat_terms(counted, repeated, id_col), bucket, shard, n_docs, buckets, shards)
    placed = dealt.withColumns({"impact": tf * F.lit(BM25_K1 + 1) / (tf + norm), "shard": shard, "term_bucket": bucket})
    placed.sortWithinPartitions("term_bucket", "term").write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy("term_bucket", "term").agg(F.count("*").alias("df"), F.max("impact").alias("top")).write.mode("overwrite").parquet(f"{path}/vocabulary")
    about = spark.range(1).select(F.lit(n_docs).cast("bigint").alias("n_docs"), F.lit(float(mean or 0.0)).alias("mean_length"), F.lit(shards).alias("shards"), F.lit(id_col).alias("id_col"))
    about.write.mode("overwrite").parquet(f"{path}/about")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    about = spark.read.parquet(f"{path}/about").first()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary"), about["n_docs"], about["mean_length"], about["shards"], about["id_col"])


def _top(rows: DataFrame, query_id: str, id_col: str, k: int, within: str | None = None) -> DataFrame:
    """The ``k`` best rows of every question, ties by the smaller id; with ``within``, of every part of a question."""
    keys = [query_id, within] if within else [query_id]
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", DIGITS)), id_col)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, questions: DataFrame, top_k: int = TOP_K, where: Column | None = None, query_id: str = "query_id", text_col: str = "query_text") -> DataFrame:
    """(question, id, score, rank): the exact ``top_k`` of every question by BM25.

    Statistics cover the whole collection; ``where``, over the carried columns,
    restricts the answers. Each question's most weighty term gives the score that
    its k-th answer has at least. Terms which together cannot reach that score
    find no answers by themselves: their lists are read only for documents that
    another term has found.
    Questions without a known term have no rows. A null question has none.
    """
    id_col = index.id_col
    asked = questions.select(query_id, F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term"))
    df = F.col("df").cast("double")
    idf = F.log1p((F.lit(float(index.n_docs)) - df + 0.5) / (df + 0.5))
    known = asked.join(index.vocabulary, "term").select(query_id, "term_bucket", "term", idf.alias("idf"), (idf * F.col("top")).alias("_most"))
    known = cut_lineage(known.distinct(), "question-terms")
    lists = (index.postings if where is None else index.postings.where(where)).select("term_bucket", "term", "shard", id_col, "impact")

    def matches(wanted: DataFrame) -> DataFrame:
        """(question, shard, id, part of the score) over all shards of the wanted terms' lists."""
        spread = wanted.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))))
        return lists.join(spread, ["term_bucket", "term", "shard"]).select(query_id, "shard", id_col, (F.col("idf") * F.col("impact")).alias("score"))

    # What the k-th answer scores at least: the k-th best of the weightiest term's own list.
    weight = Window.partitionBy(query_id).orderBy(F.desc("_most"), "term")
    ranked = known.withColumn("_r", F.row_number().over(weight))
    leading = _top(matches(ranked.where("_r = 1").select(query_id, "term_bucket", "term", "idf")), query_id, id_col, top_k, "shard").drop("rank")
    floor = _top(leading, query_id, id_col, top_k).groupBy(query_id).agg(F.when(F.count("*") == top_k, F.min("score")).alias("_floor"))
    # The lightest terms whose bounds together stay below it; a little less, so that rounding cannot matter.
    light = Window.partitionBy(query_id).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    bounded = ranked.withColumn("_sum", F.sum("_most").over(light)).join(floor, query_id, "left")
    bounded = cut_lineage(bounded.withColumn("_weak", F.coalesce(F.col("_sum") < F.col("_floor") * (1 - 1e-9), F.lit(False))), "bounded-terms")
    strong = matches(bounded.where("not _weak").select(query_id, "term_bucket", "term", "idf")).groupBy(query_id, "shard", id_col).agg(F.sum("score").alias("score"))
    strong = cut_lineage(strong, "strong-matches")
    weak = matches(bounded.where("_weak").select(query_id, "term_bucket", "term", "idf")).join(strong.select(query_id, "shard", id_col), [query_id, "shard", id_col], "left_semi")
    scored = strong.unionByName(weak).groupBy(query_id, "shard", id_col).agg(F.sum("score").alias("score"))
    best = _top(scored, query_id, id_col, top_k, "shard").drop("rank", "shard")
    return _top(best, query_id, id_col, top_k).select(query_id, id_col, "score", "rank")


def fuse(dense: DataFrame, sparse: DataFrame, query_id: str, id_col: str, top_k: int = TOP_K, mode: str = "weighted", dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT, k: int = RRF_K) -> DataFrame:
    """Both legs of every question in one: weighted scores on a common scale, or reciprocal ranks; a missing leg adds nothing."""
    if mode == "rrf":
        parts = [leg.select(query_id, id_col, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score")) for leg in (dense, sparse)]
    else:
        parts = [
            dense.select(query_id, id_col, (F.lit(dense_weight) * (1 + F.col("score")) / 2).alias("score")),
            sparse.select(query_id, id_col, (F.lit(sparse_weight * 2) / F.pi() * F.atan("score")).alias("score")),
        ]
    fused = parts[0].unionByName(parts[1]).groupBy(query_id, id_col).agg(F.sum("score").alias("score"))
    return _top(fused, query_id, id_col, top_k).select(query_id, id_col, "score", "rank")


def hybrid(
    index: Index, vectors: DataFrame, questions: DataFrame, top_k: int = TOP_K, where: Column | None = None, query_id: str = "query_id",
    text_col: str = "query_text", query_vector: str = "query_vector", vector_col: str = "embedding", mode: str = "weighted",
) -> DataFrame:
    """(question, id, score, rank) for a table of questions with a text and a vector; ``where`` holds for both legs.

    ``vectors`` has the index's id column, the vectors and the columns of ``where``. A
    question without a vector, or without a known term, has the other leg alone.
    """
    sparse = search(index, questions, top_k, where, query_id, text_col)
    rows = vectors if where is None else vectors.where(where)
    asked = questions.where(F.col(query_vector).isNotNull()).select(query_id, query_vector)
    dense = dense_search_batch(rows, asked, top_k, index.id_col, vector_col, query_id, query_vector)
    return fuse(dense, sparse, query_id, index.id_col, top_k, mode)


def scratch_index(docs: DataFrame, id_col: str, text_col: str = "text", carry: tuple[str, ...] = ()) -> Index:
    """An index in the shared scratch folder."""
    return build(docs, scratch_path(docs.sparkSession, "index"), id_col, text_col, carry)
