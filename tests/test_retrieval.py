import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeweave.operators import grounding, retrieval


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 16))
    m[50] = m[10]  # a tie
    rows = [(i, [float(np.float32(x)) for x in v], i % 4) for i, v in enumerate(m)] + [(900, [0.0] * 16, 1), (901, None, 1), (902, [1.0], 1)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>, label int").repartition(5).cache()


def direct(vectors, query, keep=lambda r: True):
    q = np.array(query) / np.linalg.norm(query)
    out = []
    for r in vectors.collect():
        if keep(r) and r.embedding and len(r.embedding) == len(q) and any(r.embedding):
            v = np.array(r.embedding)
            out.append((r.chunk_id, float(v @ q / np.linalg.norm(v))))
    return sorted(out, key=lambda x: (-round(x[1], 12), x[0]))


def test_dense_search(vectors):
    query = vectors.where("chunk_id = 10").first().embedding
    got = retrieval.dense_search(vectors, query, 7).collect()
    want = direct(vectors, query)[:7]
    assert [r.chunk_id for r in got] == [w[0] for w in want] and got[0].chunk_id == 10 and got[1].chunk_id == 50
    assert all(math.isclose(r.score, w[1], abs_tol=1e-9) for r, w in zip(got, want))
    got = retrieval.dense_search(vectors, query, 5, F.col("label") == 3).collect()
    assert [r.chunk_id for r in got] == [w[0] for w in direct(vectors, query, lambda r: r.label == 3)[:5]]


@pytest.mark.parametrize("per_scan", [4, 1000])
def test_dense_batch(spark, vectors, monkeypatch, per_scan):
    monkeypatch.setattr(retrieval, "QUERIES_PER_SCAN", per_scan)
    queries = vectors.where("chunk_id < 11").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = {}
    for r in retrieval.dense_search_batch(vectors, queries, 6).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
    for q in queries.collect():
        assert [got[q.query_id][i] for i in range(1, 7)] == [w[0] for w in direct(vectors, q.query_vector)[:6]]
    assert retrieval.dense_search_batch(vectors, queries.limit(0), 6).count() == 0


def test_centroids(vectors):
    got = {r.query_id: r.query_vector for r in retrieval.centroids(vectors.where("chunk_id < 200"), "label").collect()}
    rows = [r for r in vectors.collect() if r.chunk_id < 200]
    for label in range(4):
        assert np.allclose(got[label], np.mean([r.embedding for r in rows if r.label == label], axis=0))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = ["fire", "ice", "wolf", "Dragon", "king", "été", "the", "a-b"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))), i % 2) for i in range(120)]
    return spark.createDataFrame(rows, "chunk_id long, text string, half int").cache()


def bm25_direct(rows, query):
    split = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]
    toks = {r.chunk_id: split(r.text) for r in rows}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for term in set(split(query)):
        df = sum(term in t for t in toks.values())
        for i, t in toks.items():
            tf = t.count(term)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                out[i] = out.get(i, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


def test_bm25_and_postings(spark, docs):
    query = "Dragon été zzz dragon b"
    want = bm25_direct(docs.collect(), query)
    got = retrieval.bm25_search(docs, query, 200).collect()
    assert len(got) == len(want)
    assert all(math.isclose(dict(want)[r.chunk_id], r.score, rel_tol=1e-9) for r in got)
    half = retrieval.bm25_search(docs, query, 200, F.col("half") == 1).collect()
    assert {r.chunk_id: round(r.score, 9) for r in half} == {k: round(v, 9) for k, v in want if k % 2}
    size = docs.select(F.size(retrieval.terms(F.col("text"))).alias("n")).agg(F.count("*"), F.avg("n")).first()
    index = retrieval.write_postings(retrieval.postings(docs, "chunk_id", "text", 4), "t", 2)
    found = retrieval.search_postings(index, size[0], size[1], query, "chunk_id", 200).collect()
    assert {r.chunk_id: round(r.score, 9) for r in found} == {k: round(v, 9) for k, v in want}
    assert retrieval.bm25_search(docs, "?!", 5).count() == 0
    assert retrieval.bm25_search(docs, "absent", 5).count() == 0


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 0.9), (2, 0.5)], "chunk_id long, score double")
    sparse = spark.createDataFrame([(2, 3.0), (3, 1.0)], "chunk_id long, score double")
    got = {r.chunk_id: r.score for r in retrieval.fuse_weighted(dense, sparse, "chunk_id").collect()}
    atan = lambda s: 2 / math.pi * math.atan(s)
    want = {1: 0.7 * 0.95, 2: 0.7 * 0.75 + 0.3 * atan(3), 3: 0.3 * atan(1)}
    assert all(math.isclose(got[k], v) for k, v in want.items())
    ranks = {r.chunk_id: r.score for r in retrieval.fuse_ranks(dense, sparse, "chunk_id").collect()}
    assert math.isclose(ranks[2], 1 / 62 + 1 / 61) and math.isclose(ranks[1], 1 / 61)


def test_hybrid_over_one_table(spark, docs, vectors):
    corpus = docs.join(vectors.select("chunk_id", "embedding"), "chunk_id")
    query = corpus.orderBy("chunk_id").first().embedding
    for mode in ("weighted", "rrf"):
        rows = retrieval.hybrid_search(corpus, query, "dragon", 8, F.col("half") == 0, mode=mode).collect()
        assert len(rows) == 8 and rows[0].chunk_id == 0 or mode == "rrf"
        assert all(r.chunk_id % 2 == 0 for r in rows)


def test_quality(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c", "d"], ["a", "x"]), (2, [], ["a"])], "q int, got array<string>, want array<string>")
    out = {r.q: (r.recall, r.precision) for r in retrieval.quality(rows, "got", "want").collect()}
    assert out == {1: (0.5, 0.25), 2: (0.0, None)}
    by_join = retrieval.quality_by_join(
        rows.select("q", F.explode("got").alias("id")), rows.select("q", F.explode("want").alias("id")), "q", "id"
    ).collect()
    assert sorted((r.q, r.hits, r.recall, r.precision) for r in by_join) == [(1, 1, 0.5, 0.25), (2, 0, 0.0, None)]


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_quotes(spark, monkeypatch, bits):
    monkeypatch.setattr(grounding, "FILTER_BITS", bits)  # with 64 nearly every key passes the map
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 2)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(60)]
    quotes = []
    for i in range(80):
        t = rng.choice(texts)
        a = rng.randrange(len(t))
        quotes.append((i, t[a : a + rng.randint(1, 50)]))
    quotes += [(100, "zzz not there at all here"), (101, "!"), (102, "")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    q = spark.createDataFrame(quotes, "quote_id int, quote string")
    got = {(r.quote_id, r.doc) for r in grounding.find_quotes(d, q, "doc", "text", "quote_id", "quote").collect()}
    assert got == {(i, j) for i, s in quotes for j, t in enumerate(texts) if s and s in t}


def test_quotes_in_sources(spark):
    chunks = spark.createDataFrame([("a", "one two"), ("b", "three")], "chunk_id string, text string")
    qa = spark.createDataFrame([("q1", "two", ["b", "a"]), ("q2", "two", ["b"]), ("q3", "x", []), ("q4", "x", ["zz"])], "qa_id string, quote string, ids array<string>")
    got = grounding.quotes_in_sources(qa, chunks, "qa_id", "quote", "ids", "chunk_id", "text").collect()
    assert {r.qa_id: r.grounded for r in got} == {"q1": True, "q2": False, "q3": False, "q4": False}


def test_a_query_without_answers_counts(spark):
    expected = spark.createDataFrame([("q", 1), ("q", 2), ("r", 3)], "query_id string, id int")
    got = spark.createDataFrame([("q", 1), ("q", 9)], "query_id string, id int")
    rows = {r.query_id: (r.hits, r.recall, r.precision) for r in retrieval.quality_by_join(got, expected, "query_id", "id").collect()}
    assert rows == {"q": (1, 0.5, 0.5), "r": (0, 0.0, None)}
