import math
import re

import pytest
from pyspark.sql import functions as F

from tomeweave.operators import fulltext, questions, retrieval

WORDS = "amber brook cedar dusk ember fern glade heath iris jade".split()


def corpus(n=60):
    rows = []
    for k in range(n):
        words = [WORDS[(k * k + j * (k % 7 + 1)) % 10] for j in range(3 + k % 9)]
        rows.append((k, " ".join(words) + (" rare" if k % 17 == 0 else ""), "en" if k % 3 else "fr"))
    return [*rows, (n, "", "en"), (n + 1, None, "en")]


ASKED = [(1, "amber rare"), (2, "Dusk dusk brook fern"), (3, "nothing known"), (4, None), (5, "rare"), (6, "jade iris heath glade amber cedar")]


def plain(rows, text, keep, k):
    docs = {i: re.findall(r"[a-z]+", t or "") for i, t, _ in rows}
    mean = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in set(re.findall(r"[a-z]+", (text or "").lower())):
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            if term in d:
                tf = d.count(term)
                scores[i] = scores.get(i, 0) + math.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
    allowed = {i for i, _, lang in rows if keep is None or lang == keep}
    best = sorted((-round(s, 9), i) for i, s in scores.items() if i in allowed)[:k]
    return [(i, round(-s, 6)) for s, i in best]


@pytest.mark.parametrize("keep,k", [(None, 3), ("en", 5), ("fr", 100)])
def test_search_is_exact(spark, tmp_path, monkeypatch, keep, k):
    monkeypatch.setattr(fulltext, "index_layout", lambda n: (3, 4))
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    fulltext.build(docs, str(tmp_path / "index"), "doc_id", carry=("lang",))
    index = fulltext.open_index(spark, str(tmp_path / "index"))
    assert index.n_docs == len(rows) and index.shards == 4
    asked = spark.createDataFrame(ASKED, "query_id int, query_text string")
    got = fulltext.search(index, asked, k, None if keep is None else F.col("lang") == keep).orderBy("query_id", "rank").collect()
    for q, text in ASKED:
        assert [(r.doc_id, round(r.score, 6)) for r in got if r.query_id == q] == plain(rows, text, keep, k), (q, text)


def test_batch_equals_single_searches(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").where("text is not null")
    vectors = docs.select("doc_id", "lang", F.array(F.col("doc_id") % 5 + 0.5, F.col("doc_id") % 3 - 1.0).alias("embedding"))
    index = fulltext.scratch_index(docs, "doc_id", carry=("lang",))
    asked = spark.createDataFrame([(1, "amber rare", [1.0, 0.2]), (2, "dusk", None), (3, None, [0.3, -1.0])], "query_id int, query_text string, query_vector array<double>")
    got = fulltext.hybrid(index, vectors, asked, 4, F.col("lang") == "en").collect()
    one = retrieval.hybrid_search(docs.join(vectors.drop("lang"), "doc_id"), [1.0, 0.2], "amber rare", 4, F.col("lang") == "en", "doc_id").collect()
    assert [(r.doc_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1] == [(r.doc_id, round(r.score, 9)) for r in one]
    assert {r.query_id for r in got} == {1, 2, 3}
    ranks = fulltext.hybrid(index, vectors, asked, 4, mode="rrf").where("query_id = 3").orderBy("rank").collect()
    assert [round(r.score, 9) for r in ranks] == [round(1 / (60 + r), 9) for r in (1, 2, 3, 4)]


def test_walk_keeps_the_smallest_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("b", "d"), ("d", "e"), ("x", "x"), ("e", None)], "src string, dst string")
    starts = spark.createDataFrame([(1, "a"), (1, "a"), (2, "e"), (2, "a"), (3, "zed")], "q int, id string")
    got = {(r.q, r.id): (r.hop, r.path) for r in questions.walk(edges, starts, 2, "q").collect()}
    assert got == {
        (1, "a"): (0, "a"), (1, "b"): (1, "a > b"), (1, "c"): (1, "a > c"), (1, "d"): (2, "a > b > d"),
        (2, "a"): (0, "a"), (2, "e"): (0, "e"), (2, "b"): (1, "a > b"), (2, "c"): (1, "a > c"), (2, "d"): (1, "e > d"), (3, "zed"): (0, "zed"),
    }


def test_questions_without_a_graph_answer_are_searched(spark):
    asked = spark.createDataFrame(
        [(1, "Who is  MAT Cauthon?|mat cauthon", [1.0, 0.0]), (2, "unknown|thing", [0.0, 1.0]), (3, "unknown", None), (4, "lonely", [0.5, 0.5])],
        "question_id int, text string, query_vector array<double>",
    )
    aliases = spark.createDataFrame([("mat", "Mat Cauthon"), ("rand", "Rand"), ("solo", "lonely"), (None, "x")], "entity string, alias string")
    edges = spark.createDataFrame([("mat", "rand")], "src string, dst string")
    mentions = spark.createDataFrame([("mat", 10), ("rand", 11), ("rand", 10)], "entity string, chunk_id bigint")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (12, [0.0, 2.0])], "chunk_id bigint, embedding array<double>")
    got = questions.answer(asked, F.split("text", r"\|"), aliases, edges, mentions, vectors, 1, 2).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.leg, r.rank, r.chunk_id, r.hop, r.path) for r in got] == [
        (1, "graph", 1, 10, 0, "mat"), (1, "graph", 2, 11, 1, "mat > rand"), (2, "dense", 1, 12, None, None), (2, "dense", 2, 10, None, None),
        (4, "dense", 1, 10, None, None), (4, "dense", 2, 12, None, None),
    ]


def test_very_many_quotes_of_any_length_in_one_scan(spark):
    import random

    from tomeweave.operators import grounding

    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("", "n", "rt", "é", "-x")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 120]))) for _ in range(60)]
    quotes = ["e", "é", "-", " ", "q", "ba", "n b", ""]
    for _ in range(6_000):
        t = rng.choice(texts)
        if len(t) > 3:
            a = rng.randrange(len(t) - 2)
            quotes.append(t[a : a + rng.choice([1, 2, 3, 5, 17, 40, 90])] + rng.choice(["", "", "", "x"]))
    docs = spark.createDataFrame([*enumerate(texts), (60, None)], "doc_id int, text string").repartition(3)
    asked = spark.createDataFrame([*enumerate(quotes), (-1, None)], "quote_id int, quote string")
    found = grounding.find_quotes(docs, asked, "doc_id", "text", "quote_id", "quote")
    want = sorted((q, d) for q, quote in enumerate(quotes) if quote for d, t in enumerate(texts) if quote in t)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1  # the texts; the quotes come from a written table
    assert grounding.find_quotes(docs, asked.limit(0), "doc_id", "text", "quote_id", "quote").count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_terms_are_counted_without_a_shuffle(spark, tmp_path):
    rows = [(1, "b a  A b c", "en"), (2, None, "en"), (3, "", "fr"), (4, "one", None), (None, "x y", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = retrieval.postings(docs, "doc_id", "text", 4)
    assert exchanges(found) == 0
    want = {(1, 5, "a", 2), (1, 5, "b", 2), (1, 5, "c", 1), (4, 1, "one", 1), (None, 2, "x", 1), (None, 2, "y", 1)}
    assert {(r.doc_id, r.doc_length, r.term, r.tf) for r in found.collect()} == want
    # Rows of one id and length are one document, others of this id are not.
    again = docs.unionByName(docs).unionByName(spark.createDataFrame([(1, "a", "en")], docs.schema))
    twice = retrieval.postings(again, "doc_id", "text", 4).collect()
    assert {(r.doc_id, r.doc_length, r.term, r.tf) for r in twice} == {(i, n, t, 2 * k) for i, n, t, k in want} | {(1, 1, "a", 1)} and len(twice) == 7
    index = fulltext.build(again, str(tmp_path / "index"), "doc_id", carry=("lang",))
    assert (index.n_docs, round(index.mean_length * 6, 6)) == (6, 9.0)


@pytest.mark.parametrize("broadcast", [True, False])
def test_aliases_that_nobody_says_are_dropped_where_they_are_read(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(questions, "broadcast_counted", lambda written: written)
    aliases = spark.range(3000).selectExpr("if(id % 50 = 0, null, concat('e', id % 700)) as entity", "concat(' Name  ', id % 400, if(id % 2 = 0, ' ', '')) as alias")
    aliases = aliases.unionByName(spark.createDataFrame([("e1", None), ("e2", " "), (None, "name 7")], aliases.schema))
    asked = spark.createDataFrame([(1, ["NAME 7", "name\t7", None, ""]), (1, ["name 11"]), (None, ["name 11"]), (2, ["nobody"]), (3, None)], "question_id int, said array<string>")
    found = questions.named_entities(asked, F.col("said"), aliases, "question_id")
    # The plan before has no such filter.
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
    names = {k: {f"e{i % 700}" for i in range(3000) if i % 50 and i % 400 == k} for k in (7, 11)}
    want = {(1, e) for e in names[7] | names[11]} | {(None, e) for e in names[11]}
    got = [(r.question_id, r.id) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
