"""Exact dense search, BM25 full text, fusion of both, and retrieval quality."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tomeweave.constants import BM25_B, BM25_K1, DENSE_WEIGHT, RRF_K, SPARSE_WEIGHT, TOP_K
from tomeweave.functions.text import terms
from tomeweave.scale import once, plan_blocks
from tomeweave.session import cut_lineage, scratch_path

QUERIES_PER_SCAN = 1_024
DOCS_PER_TASK = 10_000  # when an index is written


# ------------------------------------------------------------------- dense leg
def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the vectors with ``dim`` components, those vectors scaled to length one)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    keep = np.flatnonzero(sizes == dim)
    if len(keep) < len(sizes):
        vectors = vectors.take(pa.array(keep))
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    rows = flat.reshape(-1, dim)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    alive = norms > 0
    return keep[alive], rows[alive] / norms[alive, None]


def cosine_to(query: Sequence[float], vector: Column) -> Column:
    """Cosine similarity with one query vector, in double precision; null for unusable vectors.

    The arrays arrive as one Arrow buffer per batch and are multiplied at once.
    Catalyst's higher-order functions would interpret a lambda per component.
    """
    q = np.asarray(query, dtype=np.float64)
    q = q / np.linalg.norm(q)

    @F.arrow_udf(T.DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        at, rows = _matrix(vectors, q.size)
        out = np.full(len(vectors), np.nan)
        out[at] = rows @ q
        return pa.array(out, mask=np.isnan(out))

    # Else a filter on the score would be pushed below it and compute it a second time.
    return score.asNondeterministic()(vector)


def dense_search(
    vectors: DataFrame,
    query: Sequence[float],
    top_k: int = TOP_K,
    where: Column | None = None,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``top_k`` most similar rows; the scalar predicate is applied before any scoring."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.withColumn("score", cosine_to(query, F.col(vector_col))).drop(vector_col)
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), id_col).limit(top_k)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def dense_search_batch(
    vectors: DataFrame,
    queries: DataFrame,
    top_k: int = TOP_K,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """(query, id, score, rank): the exact ``top_k`` of every query.

    Each scan multiplies Arrow batches with up to ``QUERIES_PER_SCAN`` query
    vectors and keeps only ``top_k`` rows per query and task, so neither pairs nor
    more than partitions x queries x k rows are ever shuffled. More queries than
    that are cut into ranges of the query key, one scan each, all in one plan.
    """
    blocks = plan_blocks(queries, query_id, QUERIES_PER_SCAN, at_least=1)
    ranged = queries.select(query_id, query_vector, blocks.of(F.col(query_id)).alias("_slice"))
    out = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(id_col, vectors.schema[id_col].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    legs = []
    for part in range(len(blocks.bounds) + 1):
        rows = ranged.where(F.col("_slice") == part).orderBy(query_id).collect()
        if rows:
            legs.append(_scan_leg(vectors.select(id_col, vector_col), rows, top_k, out))
    if not legs:
        return vectors.sparkSession.createDataFrame([], out).withColumn("rank", F.lit(1))
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return (
        reduce(DataFrame.unionByName, legs)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top_k)
    )


def _scan_leg(narrow: DataFrame, rows: list, top_k: int, out: T.StructType) -> DataFrame:
    names = [r[0] for r in rows]
    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    table = np.asarray([r[1] for r in rows], dtype=np.float64)
    table = table / np.linalg.norm(table, axis=1, keepdims=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(None, None)] * len(names)
        for batch in batches:
            at, unit = _matrix(batch.column(1), table.shape[1])
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))[at]
            scores = unit @ table.T
            for q in range(len(names)):
                old_ids, old_scores = held[q]
                all_ids = ids if old_ids is None else np.concatenate([old_ids, ids])
                all_scores = scores[:, q] if old_ids is None else np.concatenate([old_scores, scores[:, q]])
                pick = _best(all_ids, all_scores, top_k)
                held[q] = (all_ids[pick], all_scores[pick])
        for name, (ids, scores) in zip(names, held):
            if ids is not None and len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=k) for v, k in zip(([name] * len(ids), ids, scores), kinds)],
                    names=[f.name for f in out.fields],
                )

    return narrow.mapInArrow(scan, out)


def centroids(vectors: DataFrame, group: str, vector_col: str = "embedding") -> DataFrame:
    """(query_id, query_vector): the mean vector of each group, summed component-wise with partials."""
    parts = vectors.select(group, F.posexplode(vector_col).alias("_i", "_v"))
    means = parts.groupBy(group, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    # One row per (group, component) is left here; a group's list is as long as the vectors are.
    return means.groupBy(F.col(group).alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("query_vector")
    )


# --------------------------------------------------------------- full-text leg
def query_terms(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(F.array_sort(F.array_distinct(terms(F.lit(query))))).first()[0]


def inverse_frequency(n_docs: float, doc_freq: float) -> float:
    return float(np.log1p((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)))


def _occurrences(tokens: Column, term: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term)).cast("double")


def _saturation(tf: Column, length: Column, mean_length: float) -> Column:
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * length / F.lit(mean_length))
    return tf * F.lit(BM25_K1 + 1) / (tf + norm)


def bm25_search(
    docs: DataFrame,
    query: str,
    top_k: int = TOP_K,
    where: Column | None = None,
    id_col: str = "chunk_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, score) of the ``top_k`` rows for a text query, with collection-wide statistics.

    The texts are read and tokenised once, into a narrow table of (id, length,
    query terms found); statistics and scores both come from that table. The
    predicate restricts what is returned, not what the statistics count.
    """
    spark = docs.sparkSession
    wanted = query_terms(spark, query)
    shape = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])
    if not wanted:
        return spark.createDataFrame([], shape)
    allowed = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    tokens = docs.select(id_col, allowed.alias("_keep"), terms(F.col(text_col)).alias("_t"))
    hits = cut_lineage(
        tokens.select(
            id_col, "_keep", F.size("_t").alias("_len"), F.filter("_t", lambda t: t.isin(wanted)).alias("_h")
        ),
        "hits",
    )
    stats = hits.agg(
        F.count("*").alias("n"),
        F.avg("_len").alias("mean"),
        *[F.count_if(F.array_contains("_h", F.lit(t))).alias(f"df{i}") for i, t in enumerate(wanted)],
    ).first()
    if not stats["n"] or not stats["mean"]:
        return spark.createDataFrame([], shape)
    idf = F.create_map(
        *[
            x
            for i, t in enumerate(wanted)
            for x in (F.lit(t), F.lit(inverse_frequency(stats["n"], stats[f"df{i}"])))
        ]
    )
    found = hits.where(F.col("_keep") & (F.size("_h") > 0))
    score = F.aggregate(
        F.array_distinct("_h"),
        F.lit(0.0),
        lambda total, t: total
        + F.element_at(idf, t) * _saturation(_occurrences(F.col("_h"), t), F.col("_len"), stats["mean"]),
    )
    return found.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(top_k)


def term_counts(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """(id, carried columns, doc_length, terms): each row's own terms with their counts, in one array; nothing is shuffled."""
    rows = docs.select(id_col, *carry, F.sort_array(terms(F.col(text_col))).alias("_t"))
    # The last places of runs of equal terms.
    last = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_t"), F.lit(1))), lambda i: ~F.get("_t", i - 1).eqNullSafe(F.get("_t", i)))
    rows = rows.select("*", F.when(F.size("_t") > 0, last).otherwise(F.array().cast("array<int>")).alias("_e"))
    each = F.transform("_e", lambda e, k: F.struct(F.get("_t", e - 1).alias("term"), (e - F.coalesce(F.get("_e", k - 1), F.lit(0))).cast("bigint").alias("tf")))
    return rows.select(id_col, *carry, F.size("_t").cast("bigint").alias("doc_length"), each.alias("terms"))


def flat_terms(counted: DataFrame, repeated: DataFrame | None, id_col: str) -> DataFrame:
    """(id, carried columns, doc_length, term, tf) of ``term_counts``; only rows whose id is ``repeated`` are shuffled, to be one."""
    about = [c for c in counted.columns if c != "terms"]

    def flat(rows: DataFrame) -> DataFrame:
        return rows.select(*about, F.explode(once(F.col("terms"))).alias("_x")).select(*about, "_x.term", "_x.tf")

    if repeated is None:
        return flat(counted)
    ids = repeated.select(F.col(id_col).alias("_id"))
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    folded = flat(counted.join(ids, same, "left_semi")).groupBy(*about, "term").agg(F.sum("tf").alias("tf"))
    return flat(counted.join(ids, same, "left_anti")).unionByName(folded)


def repeated_ids(docs: DataFrame, id_col: str) -> DataFrame | None:
    """Ids that several rows have, null too; None if there are none."""
    found = cut_lineage(docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col), "repeated-ids")
    return None if found.isEmpty() else found


def postings(docs: DataFrame, id_col: str, text_col: str, buckets: int = 8) -> DataFrame:
    """(id, doc_length, term, tf, term_bucket, buckets): the inverted index as a table.

    ``buckets``, the layout, is stored with it, so a search needs not be told.

    Write it ``partitionBy("term_bucket")``: a search then reads only the folders
    of its terms and pushes the term filter into the Parquet scan.
    """
    flat = flat_terms(term_counts(docs, id_col, text_col), repeated_ids(docs, id_col), id_col)
    return flat.withColumns({"term_bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "buckets": F.lit(buckets)})


def index_layout(n_docs: int) -> tuple[int, int]:
    """(term buckets, document shards per bucket) for a collection size."""
    return min(max(n_docs // 1_000_000, 8), 4_096), min(max(n_docs // 50_000_000, 1), 64)


def by_bucket(index: DataFrame, bucket: Column, shard: Column, n_docs: int, buckets: int, shards: int) -> DataFrame:
    """Postings dealt by term bucket and shard, and each of these by term into tasks of some ``DOCS_PER_TASK`` documents' postings."""
    slices = max(1, n_docs // DOCS_PER_TASK // (buckets * shards))
    part = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(slices))
    return index.repartition(bucket, shard, part) if slices == 1 else index.repartition(buckets * shards * slices, bucket, shard, part)


def write_postings(index: DataFrame, label: str, shards: int = 1, path: str | None = None, n_docs: int = 0, buckets: int = 8) -> DataFrame:
    """Store an index by term bucket and read it back; a scratch place unless ``path`` is given.

    Rows are spread by term bucket and document shard, so the files of a bucket
    with a very common term are several instead of one; with ``n_docs``, a bucket of many is written by several tasks.
    """
    spark = index.sparkSession
    target = path or scratch_path(spark, label)
    spread = by_bucket(index, F.col("term_bucket"), F.pmod(F.xxhash64(index.columns[0]), F.lit(shards)), n_docs, buckets, shards)
    spread.write.mode("overwrite").partitionBy("term_bucket").parquet(target)
    return spark.read.schema(index.schema).parquet(target)


def search_postings(
    index: DataFrame,
    n_docs: int,
    mean_length: float,
    query: str,
    id_col: str,
    top_k: int = TOP_K,
) -> DataFrame:
    """BM25 over a postings table; equal to :func:`bm25_search`."""
    spark = index.sparkSession
    layout = index.select("buckets").first()
    buckets = layout["buckets"] if layout else 1
    wanted = query_terms(spark, query)
    folders = [
        r[0]
        for r in spark.range(1)
        .select(F.explode(F.array(*[F.lit(t) for t in wanted])).alias("t"))
        .select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int"))
        .distinct()
        .collect()
    ]
    lists = index.where(F.col("term_bucket").isin(folders) & F.col("term").isin(wanted))
    freq = {r["term"]: r["n"] for r in lists.groupBy("term").agg(F.count("*").alias("n")).collect()}
    idf = F.create_map(
        *[x for t, n in freq.items() for x in (F.lit(t), F.lit(inverse_frequency(n_docs, n)))]
    ) if freq else F.create_map(F.lit(""), F.lit(0.0))
    weight = F.element_at(idf, F.col("term")) * _saturation(
        F.col("tf").cast("double"), F.col("doc_length"), mean_length
    )
    return (
        lists.groupBy(id_col)
        .agg(F.sum(weight).alias("score"))
        .orderBy(F.desc("score"), id_col)
        .limit(top_k)
    )


# --------------------------------------------------------------------- fusion
def fuse_weighted(
    dense: DataFrame,
    sparse: DataFrame,
    id_col: str,
    top_k: int = TOP_K,
    dense_weight: float = DENSE_WEIGHT,
    sparse_weight: float = SPARSE_WEIGHT,
) -> DataFrame:
    """Weighted sum of both legs on a common 0..1 scale; a missing leg counts zero.

    Cosine maps to (1 + s) / 2 and BM25 to 2/pi * atan(s).
    """
    left = dense.select(id_col, ((1 + F.col("score")) / 2).alias("_d"))
    right = sparse.select(id_col, (F.lit(2 / np.pi) * F.atan("score")).alias("_s"))
    fused = left.join(right, id_col, "full_outer").select(
        id_col,
        (
            F.lit(dense_weight) * F.coalesce("_d", F.lit(0.0)) + F.lit(sparse_weight) * F.coalesce("_s", F.lit(0.0))
        ).alias("score"),
    )
    return fused.orderBy(F.desc("score"), id_col).limit(top_k)


def fuse_ranks(dense: DataFrame, sparse: DataFrame, id_col: str, top_k: int = TOP_K, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion. Both legs are top-k results, so ranking them is one small sort."""
    order = Window.orderBy(F.desc("score"), id_col)
    legs = [
        leg.select(id_col, "score").withColumn("_r", F.row_number().over(order)).select(id_col, "_r")
        for leg in (dense, sparse)
    ]
    return (
        legs[0]
        .unionByName(legs[1])
        .groupBy(id_col)
        .agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("_r"))).alias("score"))
        .orderBy(F.desc("score"), id_col)
        .limit(top_k)
    )


def hybrid_search(
    corpus: DataFrame,
    query_vector: Sequence[float],
    query_text: str,
    top_k: int = TOP_K,
    where: Column | None = None,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    text_col: str = "text",
    mode: str = "weighted",
    **weights: float,
) -> DataFrame:
    """Both legs with the same predicate over one table, fused to ``top_k`` rows."""
    dense = dense_search(corpus.select(*_needed(corpus, where, id_col, vector_col)), query_vector, top_k, where, id_col, vector_col)
    sparse = bm25_search(corpus.drop(vector_col), query_text, top_k, where, id_col, text_col)
    if mode == "rrf":
        return fuse_ranks(dense, sparse, id_col, top_k)
    return fuse_weighted(dense, sparse, id_col, top_k, **weights)


def _needed(corpus: DataFrame, where: Column | None, *names: str) -> list[str]:
    return list(names) if where is None else list(corpus.columns)


# -------------------------------------------------------------------- quality
def quality(rows: DataFrame, retrieved: str, expected: str) -> DataFrame:
    """Add ``recall`` and ``precision`` of two id arrays; null where the divisor is zero."""
    both = F.size(F.array_intersect(retrieved, expected)).cast("double")
    divide = lambda array: F.when(
        F.size(F.array_distinct(array)) > 0, both / F.size(F.array_distinct(array))
    )
    return rows.withColumns({"recall": divide(expected), "precision": divide(retrieved)})


def quality_by_join(retrieved: DataFrame, expected: DataFrame, query_id: str, id_col: str) -> DataFrame:
    """The same for expected sets of any size, given as (query, id) rows.

    Every query with an expected id has a row; one that retrieved nothing has recall 0 and no precision.
    """
    sizes = expected.groupBy(query_id).agg(F.count_distinct(id_col).alias("_n"))
    found = retrieved.select(query_id, id_col).distinct()
    hits = found.join(
        expected.select(query_id, id_col).distinct().withColumn("_hit", F.lit(1)), [query_id, id_col], "left"
    )
    return (
        hits.groupBy(query_id)
        .agg(F.count("*").alias("_k"), F.count("_hit").alias("hits"))
        .join(sizes, query_id, "right")
        .select(
            query_id,
            F.coalesce("hits", F.lit(0).cast("bigint")).alias("hits"),
            (F.coalesce("hits", F.lit(0)) / F.col("_n")).alias("recall"),
            (F.col("hits") / F.col("_k")).alias("precision"),
        )
    )
