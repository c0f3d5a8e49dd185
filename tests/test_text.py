import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomeweave.constants import NOT_A_TITLE, POV_NAMES
from tomeweave.functions import chapters, jsonfields, policy
from tomeweave.functions import text as tx
from tomeweave.operators import chunking


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    "text,want",
    [
        ("CHAPTER 8\nWhirlpools of Color\nbody", ("8", "Whirlpools of Color")),
        ("x\nCHAPTER 8\n\nImage\n\nAn Empty Road\n", ("8", "An Empty Road")),
        ("PROLOGUE\n\nImage\n\nSnow", ("PROLOGUE", "Snow")),
        ("PROLOGUE\nDragonmount\nbody", ("N/A", "Dragonmount")),
        ("chapter\n39\nThose Who Fight", ("39", "Those Who Fight")),
        ("CHAPTER EIGHT: The Title", ("EIGHT", "The Title")),
        ("CHAPTER: Only Title", ("N/A", "Only Title")),
        ("end of it\nCHAPTER 8", ("8", "N/A")),
        ("Epilogue", ("EPILOGUE", "N/A")),
        ("CHAPTER 8\nContents\n", ("N/A", "N/A")),
        ("nothing here", ("N/A", "N/A")),
        ("CHAPTER 1\nOne\ntext\nCHAPTER 2\nTwo", ("1", "One")),
    ],
)
def test_numbered_headers(spark, text, want):
    r = one(spark, lambda t: chapters.detect_chapter(t, "Wheel of Time"), text)
    assert (("N/A", "N/A") if r is None else (r.number, r.title)) == want


@pytest.mark.parametrize(
    "universe,text,want",
    [
        ("Harry Potter", "CHAPTER ONE\nThe Boy", ("ONE", "The Boy")),
        ("Harry Potter", "Chapter Two\nIndex\n", None),
        ("Harry Potter", "so ends\nCHAPTER 17", ("17", "N/A")),
        ("Song of Ice and Fire", "ends.\n  Tyrion \nHe rode", ("POV", "TYRION")),
        ("Song of Ice and Fire", "PROLOGUE\nWe should", ("POV", "PROLOGUE")),
        ("Song of Ice and Fire", "Tyrion rode on\n", None),
        ("Other", "see Chapter 12 there", ("12", "N/A")),
        ("Other", "see it there", None),
    ],
)
def test_other_headers(spark, universe, text, want):
    r = one(spark, lambda t: chapters.detect_chapter(t, universe), text)
    assert (None if r is None else (r.number, r.title)) == want


def test_false_titles(spark):
    yes = ["Image", "12.JPG", "e97_i02.jpg", "cover_1.png ", "Figure 3", "Table of  Contents", "Books by A", "a preview of X", "n/a", "Index\n"]
    no = ["The Image", "Index of Things", "12.jpgs", "Maps", "Booksby A", ""]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    got = {r.t: r.r for r in df.select("t", chapters.is_false_title(F.col("t")).alias("r")).collect()}
    assert all(got[t] for t in yes) and not any(got[t] for t in no)
    for t in yes + no:  # the same patterns under Python's own engine
        assert got[t] == any(re.match("(?i)" + p, t.strip()) for p in NOT_A_TITLE)
    assert len(NOT_A_TITLE) == 28 and len(POV_NAMES) == 28


def test_scalars(spark):
    df = spark.createDataFrame([("héllo  \x1f",)], "t string")
    assert df.select(tx.strip(F.col("t"))).first()[0] == "héllo  \x1f".strip()
    assert one(spark, tx.mask_key, "abcdwxyz") == "...wxyz"
    assert one(spark, tx.mask_key, "abcd") == "***"
    assert one(spark, tx.token_estimate, "abcde") == 2
    assert one(spark, tx.word_count, "  a b\n c d ") == 4
    assert one(spark, lambda t: tx.padded_id("%s_%05d", t, F.lit(1234567)), "a") == "a_1234567"
    assert one(spark, lambda t: tx.or_default(t, "d"), "") == "d"
    html = "<p>a<script>var x='<p>';</script> &amp;lt; <!-- c --> b</p><style>p{}</style>"
    assert one(spark, tx.html_to_text, html) == "a &lt; b"
    assert policy.safe_limit(200_000, 0.1) == 180_000


def test_error_policy(spark):
    rows = [("Error 429", 1, "rate_limit", 60.0), ("quota exceeded", 6, "rate_limit", 64.0), ("503 timeout 429", 1, "rate_limit", 60.0),
            ("Service Unavailable", 2, "transient", 4.0), ("boom", 3, "other", 8.0)]
    df = spark.createDataFrame([r[:2] for r in rows], "m string, a int").withColumn("k", policy.error_class(F.col("m")))
    got = df.select("m", "k", policy.backoff_seconds(F.col("k"), F.col("a")).alias("b")).collect()
    assert [(r.k, r.b) for r in got] == [r[2:] for r in rows]


def test_json_fallback(spark):
    values = ['{"k": 1}', ' {"a": {"b": 2}}', "{bad", "plain", None]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r[0] for r in df.select(jsonfields.parse_status(F.col("t"))).collect()] == ["object", "object", "invalid", "string", "null"]


def subsequence_cover(text, chunks, overlap):
    """Each chunk stands in the text, in order, and no non-space character is skipped."""
    at, reached = 0, 0
    for c in chunks:
        found = text.find(c, at)
        assert found >= 0
        assert not text[reached:found].strip()
        at, reached = found, max(reached, found + len(c))
    assert not text[reached:].strip()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='ab. !?"\n ', max_size=400))
def test_splitter_invariants(text):
    chunks = chunking.split_text(text, chunking.separators_for(), 40, 12)
    assert all(0 < len(c) <= 40 for c in chunks)
    subsequence_cover(text, chunks, 12)


def test_splitter_headers_and_overlap():
    seps = chunking.separators_for("Wheel of Time")
    text = "start here.\nCHAPTER 1\nfirst part\nCHAPTER 2\nsecond part"
    assert chunking.split_text(text, seps, 25, 0) == ["start here.", "CHAPTER 1\nfirst part", "CHAPTER 2\nsecond part"]
    words = " ".join(f"w{i:03d}" for i in range(100))
    chunks = chunking.split_text(words, chunking.separators_for(), 60, 20)
    for a, b in zip(chunks, chunks[1:]):
        shared = next(k for k in range(min(len(a), len(b)), -1, -1) if a.endswith(b[:k]))
        assert 0 < shared <= 20
    assert chunking.split_text("", seps, 25, 0) == []
    assert len(chunking.separators_for("harry potter")) == 12


def test_fixed_stride(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    df = spark.createDataFrame([(1, "s", text), (2, "s", ""), (3, "s", "é" * 90), (4, "t", "x")], "d long, g string, text string")
    rows = chunking.stride_rag_chunks(df, "g", "d", size=100, overlap=20).orderBy("chunk_id").collect()
    mine = [r for r in rows if r.d == 1]
    assert [r.chunk_text for r in mine] == [text[i : i + 100] for i in range(0, 1000, 80)]
    assert [r.chunk_id for r in rows if r.g == "s"] == [f"s_rag_{i:05d}" for i in range(13 + 2)]
    assert [r.chunk_id for r in rows if r.g == "t"] == ["t_rag_00000"]


@pytest.mark.parametrize("rows_per_block", [3, 1000])
def test_chapter_fill(spark, rows_per_block):
    rows = [("a", 0, None, None), ("a", 1, "1", "N/A"), ("a", 2, None, None), ("a", 3, "N/A", "T"), ("a", 4, None, None),
            ("b", 0, None, None), ("b", 1, "2", "U"), ("b", 2, None, None)]
    df = spark.createDataFrame(rows, "book string, i long, n string, t string")
    found = F.when(F.col("n").isNotNull(), F.struct(F.col("n").alias("number"), F.col("t").alias("title")))
    got = chunking.fill_chapters(df, found, ["book"], ["i"], rows_per_block=rows_per_block).orderBy("book", "i").collect()
    assert [(r.chapter_number, r.chapter_title) for r in got] == [
        ("N/A", "N/A"), ("1", "N/A"), ("1", "N/A"), ("N/A", "T"), ("N/A", "T"), ("N/A", "N/A"), ("2", "U"), ("2", "U")]


def test_rag_chunks(spark):
    body = " ".join(["word"] * 300)
    books = spark.createDataFrame([(0, "one", f"CHAPTER 1\nStart\n{body}\nCHAPTER 2\nNext\n{body}"), (1, "two", body)],
                                  "book_order long, book_name string, text string")
    rows = chunking.rag_chunks(books, "Wheel of Time", 400, 80).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == [f"wheel_of_time_rag_{i:05d}" for i in range(len(rows))]
    assert rows[0].metadata.chapter_title == "Start" and rows[0].series == "wheel_of_time"
    last_of_one = [r for r in rows if r.metadata.book_name == "one"][-1]
    assert last_of_one.metadata.chapter_number == "2"
    assert {r.metadata.chapter_number for r in rows if r.metadata.book_name == "two"} == {"N/A"}
