"""A corpus made ready for training: five stages over ``documents``, each written before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import decontaminate, quality, secrets, sentencepieces, simhash
from tomeweave.llm.base import rows_named
from tomeweave.llm.queries import VOCABULARY
from tomeweave.session import cut_lineage, scratch_path, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW, ORDER = "__row", "__order"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, as they are. Null and empty texts have no words and go."""
    return quality.kept_rows(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, then the smallest text hash.

    Near-duplicates have an exact similarity of 0.8 or more over shingles of five words; groups are those of the texts, so rows that share an id but are no near-duplicates all stay,
    and a row without an id stays if no other one of its group has an id. Of rows equal in
    id and text one stays: that with the smallest hash of its other columns.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = (F.col("doc_id").isNull(), F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64(*others), F.col(ROW))
    # Rows have numbers once they are written.
    rows = cut_lineage(docs.withColumn(ROW, F.monotonically_increasing_id()).withColumn(ORDER, F.struct(*order)), "numbered")
    found = simhash.similar_groups(rows.select(ROW, "text"), ROW)
    # Partial minima fold a large group before it is shuffled.
    first = found.join(rows.select(ROW, ORDER), ROW).groupBy("group").agg(F.min(ORDER).alias("_first"))
    keep = cut_lineage(first.select(F.col(f"_first.{ROW}").alias(ROW)), "kept")
    # Those that go are few, and so are sent to the texts, as ids or bits.
    gone = cut_lineage(rows.select(ROW).join(keep, ROW, "left_anti"), "dropped")
    return rows_named(rows, gone, ROW, named=False).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of any benchmark item; each row is judged by its own text, whatever its id."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.removed(docs, benchmark)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and ``n_chars`` counted anew where a text changed."""
    forest, dictionary = secrets.prepared(docs)
    changed = secrets.masked(docs.withColumn("_old", F.col("text")), forest, dictionary)
    count = F.when(F.col("text").eqNullSafe(F.col("_old")), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint"))
    return changed.withColumn("n_chars", count).select(*docs.columns)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as piece ids, with whether they decode to their text."""
    vocab = sentencepieces.load(VOCABULARY)
    # A digest stands for the text, so that it does not travel on with the pieces.
    marked = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    encoded = sentencepieces.encode(marked, vocab, keep=("lang", "source", "_digest"))
    decoded = sentencepieces.decode(encoded, vocab)
    return decoded.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_pieces"),
        (F.sha2("decoded", 256) == F.col("_digest")).alias("round_trip"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    run_stage.__doc__ = stage.__doc__
    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _shipped(quality_stage)),
    ("simhash_near_dedup", _shipped(near_duplicate_stage)),
    ("decontamination", _shipped(decontamination_stage)),
    ("secret_scan", _shipped(secret_stage)),
    ("sentencepiece", _shipped(piece_stage)),
]

#: Fingerprints, a forest and Viterbi are not in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
