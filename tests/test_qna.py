import pytest
from pyspark.sql import functions as F

from tomeweave.operators import qna


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 18, 20, 47])
@pytest.mark.parametrize("size,overlap", [(10, 2), (4, 4), (3, 7), (5, 0)])
def test_overlapping_windows(spark, n, size, overlap):
    df = spark.range(n).select(F.lit("s").alias("series"), F.col("id").alias("chunk_id"))
    members = qna.overlapping_members(df, ["series"], ["chunk_id"], size, overlap, rows_per_block=13)
    got = {}
    for r in members.collect():
        got.setdefault(r.batch_index, []).append(r.chunk_id)
    step = size - overlap if size > overlap else size
    want = [list(range(n))[i : i + size] for i in range(0, n, step)]
    assert [sorted(got[i]) for i in sorted(got)] == want


def test_tumbling_run_of_batches(spark):
    df = spark.range(95).select(F.lit("s").alias("series"), F.col("id").alias("chunk_id"))
    members = qna.tumbling_members(df, ["series"], ["chunk_id"], 10, start_batch=2, max_batches=3, rows_per_block=7)
    assert sorted(r.chunk_id for r in members.collect()) == list(range(20, 50))
    assert qna.tumbling_members(df, ["series"], ["chunk_id"], 10).select("batch_index").distinct().count() == 10


def test_batch_description_and_text(spark):
    rows = [("s", i, "B" if i % 2 else "", f"w{i} x", 3 if i == 0 else None) for i in range(4)]
    df = spark.createDataFrame(rows, "series string, chunk_id int, book string, text string, tokens int")
    members = qna.tumbling_members(df, ["series"], ["chunk_id"], 3)
    narrow = qna.measured(members, "text", "tokens")
    assert "text" not in narrow.columns
    got = qna.describe_batches(narrow, ["series"], "chunk_id", F.col("book"), F.col("n_tokens"), F.col("n_characters")).orderBy("batch_index").collect()
    assert [(r.batch_id, r.n_chunks, r.included_books, r.token_count) for r in got] == [("0_to_2", 3, ["B"], 7), ("3_to_3", 1, ["B"], 2)]
    text = qna.batch_text(members, ["series"], "chunk_id", "text").orderBy("batch_index").first()
    assert text.batch_text == "\n\n[Chunk ID: 0]\nw0 x\n\n[Chunk ID: 1]\nw1 x\n\n[Chunk ID: 2]\nw2 x" and text.chunk_ids == "0, 1, 2"
    prompt = qna.batch_text(members, ["series"], "chunk_id", "text", "evaluation", F.col("book")).orderBy("batch_index").collect()[1]
    assert prompt.batch_text == "=== CHUNK_ID: 3 ===\n[Book: B | Chapter: Unknown]\nw3 x\n=== END 3 ===\n"


def test_pending_batches(spark):
    batches = spark.createDataFrame([("a",), ("b",), ("c",)], "batch_id string")
    stored = spark.createDataFrame([("a", "s", "lore"), ("a", "s", "lore"), ("b", "s", "magic"), (None, "s", "lore")], "bid string, series string, category string")
    done = qna.processed_batches(stored, {"series": "s", "category": "lore"}, "bid")
    assert [r[0] for r in qna.pending_batches(batches, done).orderBy("batch_id").collect()] == ["b", "c"]


def test_source_ids_keep_order_and_drop_empty(spark):
    members = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "batch int, chunk_id string")
    pairs = spark.createDataFrame([("q1", 0, ["b", "c", "a"], "x"), ("q2", 0, ["c"], "y"), ("q3", 1, ["c", "c"], "z")], "qa_id string, batch int, ids array<string>, keep string")
    got = {r.qa_id: (r.ids, r.keep) for r in qna.validate_source_ids(pairs, members, ["qa_id"], ["batch"], "ids", "chunk_id").collect()}
    assert got == {"q1": (["b", "a"], "x"), "q3": (["c", "c"], "z")}
    row = pairs.select(qna.keep_listed(F.col("ids"), F.array(F.lit("b"), F.lit("a"))).alias("k")).first()
    assert row.k == ["b", "a"]


def test_source_metadata(spark):
    chunks = spark.createDataFrame([("a", "B1", "T"), ("b", "B1", None), ("c", "B0", "")], "chunk_id string, book string, chapter string")
    qa = spark.createDataFrame([("q1", ["c", "a", "b"]), ("q2", ["zz"]), ("q3", [])], "qa_id string, ids array<string>")
    got = {r.qa_id: (r.included_books, r.included_chapters) for r in qna.source_metadata(qa, chunks, "qa_id", "ids", "chunk_id", "book", "chapter").collect()}
    assert got == {"q1": (["B0", "B1"], ["T"]), "q2": ([], []), "q3": ([], [])}


def test_audit_outcomes(spark):
    chunks = spark.createDataFrame([("a", "A"), ("b", "B")], "chunk_id string, text string")
    qa = spark.createDataFrame([("q1", ["b", "a"]), ("q2", ["zz"]), ("q3", []), ("q4", None)], "qa_id string, ids array<string>")
    got = {r.qa_id: r.source_text for r in qna.sample_with_sources(qa, chunks, "qa_id", "ids", "chunk_id", "text", 10).collect()}
    assert got["q1"] == "[Chunk ID: a]\nA\n\n[Chunk ID: b]\nB"
    assert got["q2"].startswith("WARNING: Chunks with IDs [zz]") and got["q3"] == got["q4"] == "No source chunk IDs provided in metadata."
    assert qna.sample_with_sources(qa, chunks, "qa_id", "ids", "chunk_id", "text", 2).count() == 2


def test_constraints(spark):
    rows = [("q" * 10, "a" * 50, "e" * 20, "simple", ["x"]), ("q", "a", None, "other", []), ("q" * 10, "a" * 50, "e" * 20, None, None)]
    df = spark.createDataFrame(rows, "q string, a string, e string, c string, i array<string>")
    faults = qna.constraint_faults(*[F.col(c) for c in "qaeci"])
    got = [r[0] for r in df.select(faults).collect()]
    assert got == [[], ["question", "answer", "evidence_quote", "source_chunk_ids", "complexity"], ["source_chunk_ids", "complexity"]]


@pytest.mark.parametrize("rows_per_block", [4, 1000])
def test_abort_and_totals(spark, rows_per_block):
    rows = [("s", i, i in (2, 5, 6, 9)) for i in range(12)] + [("t", i, False) for i in range(3)]
    df = spark.createDataFrame(rows, "series string, i long, failed boolean")
    kept = qna.until_abort(df, ["series"], ["i"], F.col("failed"), rows_per_block=rows_per_block)
    assert sorted((r.series, r.i) for r in kept.collect()) == [("s", i) for i in range(7)] + [("t", i) for i in range(3)]
    counts = {r.series: r for r in qna.progress(kept, ["series"], ["i"], F.col("failed"), F.lit(2)).collect()}
    assert (counts["s"].processed_batches, counts["s"].failed_batches, counts["s"].total_qa_pairs, counts["s"].last_processed) == (4, 3, 8, 4)
    qa = spark.createDataFrame([(0, ["a", "b"]), (0, ["a"]), (1, []), (2, None)], "batch int, ids array<string>")
    assert tuple(qna.qa_totals(qa, "ids", "batch").first()) == (4, 2, 3)


def test_ids_and_categories(spark):
    pairs = spark.createDataFrame([("b", "lore", 2), ("b", "lore", 1), ("c", "magic", 9), ("c", "none", 1)], "batch string, category string, o long")
    named = qna.with_category_name(qna.number_pairs(pairs, ["batch", "category"], ["o"]))
    got = named.select(qna.category_qa_id(F.col("batch"), F.col("category"), F.col("pair_index")).alias("i"), "o", "category_name").collect()
    assert {(r.i, r.o) for r in got} == {("b_lore_0000", 1), ("b_lore_0001", 2), ("c_magic_0000", 9), ("c_none_0000", 1)}
    assert {r.category_name for r in got} == {"Lore & World-Building", "Magic, Weaves & Power Mechanics", None}
