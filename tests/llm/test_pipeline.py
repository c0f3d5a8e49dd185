import os

import pytest

import corpus_pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == sizes[4] and last.where("not round_trip").count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    near = corpus_pipeline.near_duplicate_stage(spark, plain, SF)
    assert sorted((r.doc_id for r in near.collect()), key=str) == [1, 4, 5, 6]
    nameless = spark.createDataFrame([(None, "a b c", "en", "s", 1)] * 2 + [(None, "d e f", "en", "s", 1)], plain.schema)
    assert corpus_pipeline.near_duplicate_stage(spark, nameless, SF).count() == 2
    masked = corpus_pipeline.secret_stage(spark, plain, SF)
    assert masked.exceptAll(plain).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs.select(*plain.columns), SF).count() == 0


def test_near_duplicates_leave_whole_texts_where_they_are(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(2, text, None, "s", 1), (1, text, None, "s", 1), (None, "other words", None, "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = corpus_pipeline.near_duplicate_stage(spark, df, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.doc_id for r in out.collect()} == {1, None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
