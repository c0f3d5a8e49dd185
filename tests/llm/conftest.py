import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty, blank and repeated rows, a long text, and columns whose names operators use inside."""
    rows = [
        (1, None, "en", None, None, "x"), (2, "", None, "s", 0, "x"), (3, " \n\t ", "en", "s", 4, None),
        (4, "word " * 20_000, "en", "s", 100_000, "x"), (5, "the same text", "fr", "s", 13, "x"),
        (5, "the same text", "fr", "s", 13, "x"), (None, "the same text", None, "s", 13, "x"), (6, "日本語 ñandú 😀 a▁b", "es", "s", 15, "x"),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string"
    return spark.createDataFrame(rows, schema).withColumnsRenamed({"words": "_w"}).selectExpr("*", "1 as kept", "2 as fp", "3 as ids", "'q' as start")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
