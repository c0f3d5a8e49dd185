"""Questions over a graph: find the entities they name, walk, gather context, and search what the graph cannot answer.

All questions of a table go through every step together. A walk's state is a
row (question, vertex) with the path that led there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.constants import TOP_K
from tomeweave.operators.entities import alias_key
from tomeweave.operators.retrieval import dense_search_batch
from tomeweave.scale import broadcast_counted, once
from tomeweave.session import cut_lineage

STEP = " > "


def named_entities(questions: DataFrame, phrases: Column, aliases: DataFrame, question_id: str, entity: str = "entity", alias: str = "alias") -> DataFrame:
    """(question, id): entities one of whose aliases is a phrase of the question, in any case and spacing.

    ``phrases`` is an array of what may be a name in a question. Aliases that no question says are
    dropped where they are read, by the hashes of what is said, so neither a shuffle nor a task's
    table of distinct rows holds them. The join is on the alias itself; a very common one is split
    by adaptive execution, and the pairs are made distinct.
    """
    said = questions.select(question_id, F.explode(once(phrases)).alias("_p")).select(question_id, alias_key(F.col("_p")).alias("_key"))
    said = cut_lineage(said.where("_key is not null").distinct(), "phrases")
    hashes = cut_lineage(said.select(F.xxhash64("_key").alias("_hash")).distinct(), "phrase-hashes")
    every = aliases.select(F.col(entity).alias("id"), alias_key(F.col(alias)).alias("_key")).where("id is not null and _key is not null")
    known = every.withColumn("_hash", F.xxhash64("_key")).join(broadcast_counted(hashes), "_hash", "left_semi").select("id", "_key").distinct()
    return said.join(known, "_key").select(question_id, "id").distinct()


def walk(edges: DataFrame, starts: DataFrame, hops: int, question_id: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(question, id, hop, path) of all vertices within ``hops`` undirected steps of a question's starts.

    Of several shortest paths the smallest is kept. A round joins only the newest
    states with the edges; states that a question has reached before are taken out by
    an anti-join, so no question walks a vertex twice.
    """
    forth = edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to"))
    both = forth.unionByName(forth.select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))).where("_from is not null and _to is not null")
    both = cut_lineage(both.distinct(), "steps")
    first = starts.select(question_id, "id").distinct().select(question_id, "id", F.lit(0).alias("hop"), F.col("id").alias("path"))
    reached = frontier = cut_lineage(first, "states")
    for hop in range(1, hops + 1):
        step = frontier.join(both, F.col("id") == F.col("_from")).select(question_id, F.col("_to").alias("id"), F.concat_ws(STEP, "path", "_to").alias("path"))
        new = step.groupBy(question_id, "id").agg(F.min("path").alias("path")).join(reached.select(question_id, "id"), [question_id, "id"], "left_anti")
        frontier = cut_lineage(new.select(question_id, "id", F.lit(hop).alias("hop"), "path"), "states")
        reached = reached.unionByName(frontier)
    return reached


def context(reached: DataFrame, mentions: DataFrame, question_id: str, entity: str, chunk_id: str, top_k: int = TOP_K) -> DataFrame:
    """(question, chunk, hop, n_entities, path, rank): the ``top_k`` nearest chunks of every question.

    Nearer chunks first, then those that mention more of the reached entities, then the smaller id.
    """
    near = reached.join(mentions.select(F.col(entity).alias("id"), chunk_id).distinct(), "id")
    chunks = near.groupBy(question_id, chunk_id).agg(
        F.min("hop").alias("hop"), F.count("*").alias("n_entities"), F.min_by("path", F.struct("hop", "path")).alias("path")
    )
    order = Window.partitionBy(question_id).orderBy("hop", F.desc("n_entities"), chunk_id)
    return chunks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def answer(
    questions: DataFrame, phrases: Column, aliases: DataFrame, edges: DataFrame, mentions: DataFrame, vectors: DataFrame, hops: int = 2, top_k: int = TOP_K,
    question_id: str = "question_id", query_vector: str = "query_vector", entity: str = "entity", chunk_id: str = "chunk_id", vector_col: str = "embedding",
) -> DataFrame:
    """(question, leg, rank, chunk, hop, path, score): graph context, or dense search where the graph has none.

    A question whose entities lead to no chunk is sent to the vectors; one without a
    vector then has no rows. ``hop`` and ``path`` are the graph leg's, ``score`` the dense leg's.
    """
    starts = named_entities(questions, phrases, aliases, question_id, entity)
    found = cut_lineage(context(walk(edges, starts, hops, question_id), mentions, question_id, entity, chunk_id, top_k), "graph-answers")
    left = questions.join(found.select(question_id).distinct(), question_id, "left_anti").where(F.col(query_vector).isNotNull())
    dense = dense_search_batch(vectors, left.select(question_id, query_vector), top_k, chunk_id, vector_col, question_id, query_vector)
    columns = [question_id, "leg", "rank", chunk_id, "hop", "path", "score"]
    graph_leg = found.withColumns({"leg": F.lit("graph"), "score": F.lit(None).cast("double")})
    dense_leg = dense.withColumns({"leg": F.lit("dense"), "hop": F.lit(None).cast("int"), "path": F.lit(None).cast("string")})
    return graph_leg.select(*columns).unionByName(dense_leg.select(*columns))
