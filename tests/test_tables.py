import datetime as dt

import pytest
from pyspark.sql import functions as F

from tomeweave.models.boundary import HashedEmbedder
from tomeweave.operators import incremental, tables


def test_upsert_sets_supplied_fields_only(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "k int, p string, q string")
    updates = spark.createDataFrame([(2, "B"), (3, None), (4, "D")], "k int, p string")
    got = {r.k: (r.p, r.q) for r in tables.upsert(base, updates, ["k"]).collect()}
    assert got == {1: ("a", "x"), 2: ("B", "y"), 3: (None, "z"), 4: ("D", None)}


def test_upsert_explicit_null_and_per_row_fields(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    updates = spark.createDataFrame([(1, None, "X", ["p"]), (2, "n", None, ["q"])], "k int, p string, q string, __set array<string>")
    got = {r.k: (r.p, r.q) for r in tables.upsert(base, updates, ["k"]).collect()}
    assert got == {1: (None, "x"), 2: ("b", None)}


def test_bulk_later_update_wins_field_by_field(spark):
    base = spark.createDataFrame([(1, "a", "x")], "k int, p string, q string")
    updates = spark.createDataFrame(
        [(1, "p1", "q1", ["p", "q"], 1), (1, "p2", None, ["p"], 2), (9, "n", None, ["p"], 3)],
        "k int, p string, q string, __set array<string>, __seq int",
    )
    got = {r.k: (r.p, r.q) for r in tables.upsert(base, updates, ["k"]).collect()}
    assert got == {1: ("p2", "q1"), 9: ("n", None)}


def test_bulk_without_order_may_not_repeat_a_key(spark):
    base = spark.createDataFrame([(1, "a")], "k int, p string")
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "k int, p string")
    with pytest.raises(Exception, match="repeats a key"):
        tables.upsert(base, twice, ["k"]).collect()


def test_created_at_is_kept_unless_asked(spark):
    old, new = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    base = spark.createDataFrame([(1, old)], "k int, created_at timestamp")
    updates = spark.createDataFrame([(1, new), (2, new)], "k int, created_at timestamp")
    kept = {r.k: r.created_at for r in tables.upsert(base, updates, ["k"]).collect()}
    assert kept == {1: old, 2: new}
    replaced = {r.k: r.created_at for r in tables.upsert(base, updates, ["k"], keep_created_at=False).collect()}
    assert replaced == {1: new, 2: new}


def test_keep_last_with_a_hot_key(spark):
    rows = [("hot", i, f"v{i}") for i in range(500)] + [(None, 1, "n1"), (None, 2, "n2"), ("b", 7, "b7")]
    df = spark.createDataFrame(rows, "k string, seq int, v string")
    assert {(r.k, r.v) for r in tables.keep_last(df, ["k"], "seq").collect()} == {("hot", "v499"), (None, "n2"), ("b", "b7")}


def test_find(spark):
    df = spark.createDataFrame([("s", "b", 2), ("s", "a", 1), ("t", "c", 3)], "series string, id string, n int")
    assert [r.id for r in tables.find(df, {"series": "s", "n": None}, ["id"], 0).collect()] == ["a", "b"]
    assert [r.id for r in tables.find(df, {"series": ""}, ["id"], 2).collect()] == ["a", "b"]
    assert tables.find_one(df, {"id": "zz"}).count() == 0
    keys = spark.createDataFrame([(0, "c"), (1, "zz"), (2, "a"), (3, "c")], "pos int, id string")
    assert [r.id for r in tables.find_ordered(df, keys, "id").collect()] == ["c", "a", "c"]
    assert [r.id for r in tables.without(df, F.col("n") > 1).collect()] == ["a"]
    assert tables.duplicate_keys(df, ["series"]).collect()[0].n_rows == 2
    arrays = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"])], "q int, ids array<string>")
    assert [r.q for r in tables.containing(arrays, "ids", "x").collect()] == [1]
    assert tables.sample_by_hash(df, "id", 2).count() == 2


def test_store_round_trip(spark, tmp_path):
    store = tables.TableStore(spark, str(tmp_path))
    assert store.read("rag_chunks").count() == 0
    chunks = spark.createDataFrame([("c1", "s", "one"), ("c2", "s", "two"), ("c3", "t", "three")], "chunk_id string, series string, text_content string")
    assert store.bulk_upsert("rag_chunks", chunks) == 3
    first = {r.chunk_id: r for r in store.read("rag_chunks").collect()}
    assert store.bulk_upsert("rag_chunks", chunks.where("chunk_id = 'c2'").withColumn("text_content", F.lit("TWO"))) == 1
    second = {r.chunk_id: r for r in store.read("rag_chunks").collect()}
    assert second["c2"].text_content == "TWO" and second["c2"].created_at == first["c2"].created_at
    assert second["c2"].updated_at > first["c2"].updated_at and second["c1"].updated_at == first["c1"].updated_at
    assert store.delete_where("rag_chunks", F.col("series") == "s") == 2
    assert [r.chunk_id for r in store.read("rag_chunks").collect()] == ["c3"]
    assert {r.table_name: r.n_rows for r in store.counts().collect()}["rag_chunks"] == 1
    assert store.bulk_upsert("rag_chunks", chunks.limit(0)) == 0
    before = store._versions("rag_chunks")
    assert store.bulk_upsert("rag_chunks", chunks.where("chunk_id = 'c1'")) == 1  # a new key is appended
    assert store._versions("rag_chunks") == before and store.read("rag_chunks").count() == 2


def test_cache_and_pending(spark, tmp_path):
    texts = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)], "i int, text string")
    cache = spark.createDataFrame([], "text_hash string, embedding array<float>, model string")
    misses = incremental.cache_misses(texts, cache, "text")
    assert misses.count() == 11
    rows = incremental.cache_rows(misses, HashedEmbedder(8))
    joined = incremental.with_cache(texts, rows, "text", "hashed-bow").collect()
    assert len(joined) == 30 and all(len(r.embedding) == 8 for r in joined)
    assert incremental.cache_misses(texts, rows, "text", "hashed-bow").count() == 0
    assert incremental.cache_misses(texts, rows, "text", "other").count() == 11


def test_embedding_resumes(spark, tmp_path):
    class Failing(HashedEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("503 unavailable")
            return super().embed(texts)

    schema = "chunk_id string, series string, text_content string, character_count bigint, metadata struct<book_name:string,chapter_number:string,chapter_title:string,universe:string>"
    rows = [(f"c{i}", "s", "bad text" if i == 3 else f"text {i}", 5, ("b", "1", None, "u")) for i in range(6)]
    chunks = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "emb")
    incremental.embed_pending(chunks, path, Failing(8))
    assert {r.chunk_id for r in spark.read.parquet(path).collect()} == {"c0", "c1", "c2", "c4", "c5"}
    incremental.embed_pending(chunks, path, HashedEmbedder(8))
    stored = spark.read.parquet(path)
    assert stored.count() == 6 and stored.select("chunk_id").distinct().count() == 6
    vectors = incremental.vector_rows(stored).where("chunk_id = 'c3'").first()
    assert vectors.book_title == "b" and vectors.chapter_title == "" and vectors.text == "bad text"
