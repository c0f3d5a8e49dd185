import random
import re

from tomeweave.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, window):
    out = {}
    for key, text in docs:
        w = words(text)
        hit, who = set(), set()
        for item, t in items:
            b = words(t)
            width = min(window, len(b))
            for i in range(len(b) - width + 1 if b else 0):
                for j in range(len(w) - width + 1):
                    if w[j : j + width] == b[i : i + width]:
                        hit |= set(range(j, j + width))
                        who.add(item)
        out[key] = (len(w), sorted(hit), sorted(who))
    return out


def case(seed):
    rng = random.Random(seed)
    some = ["aa", "bb", "Cc", "déj", "e" * 20, "e" * 19 + "f", "9", "x1"]
    text = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choice(some) for _ in range(n))
    items = [(str(k), text(rng.choice([2, 3, 6, 9]))) for k in range(7)] + [("7", None), ("8", "..."), ("9", "")]
    docs = [(k, text(rng.choice([0, 1, 5, 40]))) for k in range(25)] + [(25, None), (26, items[0][1]), (27, "z " + items[1][1] + " z")]
    return docs, items


def test_against_brute_force(spark):
    for seed in range(3):
        docs, items = case(seed)
        want = plain(docs, items, 4)
        d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
        b = spark.createDataFrame(items, "item_id string, text string")
        for block in (20, 10**6):  # several passes, and one
            found = decontaminate.matches(d, b, 4, block_bytes=block)
            got = {r.doc_id: (r.n_words, [x for s in r.spans for x in range(s.start, s.end)], r["items"]) for r in found.collect()}
            assert got == want
        clean = {r.doc_id for r in decontaminate.removed(d, b, 4).collect()}
        assert clean == {k for k, v in want.items() if not v[1]}


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "q a b c d q"), (2, "x a b c d e y"), (3, "a b c d e f g h")], "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([("i", "a b c d e f"), ("j", "c d e y")], "item_id string, text string")
    found = decontaminate.longest_matches(decontaminate.matches(docs, items, 3)).collect()
    assert sorted(map(tuple, found)) == [("i", 6, 3, 0), ("j", 4, 2, 3)]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the same text"), (None, None)], "item_id bigint, text string")
    rows = decontaminate.matches(odd_docs, items).collect()
    assert len(rows) == odd_docs.count()
    assert sorted((r.doc_id or 0) for r in rows if r["items"] == ["1"]) == [0, 5, 5]
    assert decontaminate.matches(no_docs, items).count() == 0
    assert decontaminate.matches(odd_docs, items.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.removed(odd_docs, items).columns == odd_docs.columns


def test_rows_that_share_an_id_are_judged_alone(spark):
    rows = [(None, "a clean one"), (None, "x aa bb cc dd y"), (7, "also clean"), (7, "aa bb cc dd"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as _key", "2 as _contaminated", "3 as items")
    items = spark.createDataFrame([("i", "aa bb cc dd")], "item_id string, text string")
    kept = decontaminate.removed(docs, items, 3)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(7, "also clean"), (8, None), (None, "a clean one")]


def test_rows_pass_through_the_search_without_a_shuffle(spark):
    rows = [(None, "a clean one"), (7, "x aa bb cc dd y"), (7, "also clean"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "text", "doc_id", "named_struct('a b', 1, 'c', array(doc_id, null)) as `s.t`", "timestamp'2020-01-01 10:00:00' as spans", "X'00ff' as best", "cast(null as decimal(9,2)) as doc_id_"
    )
    items = spark.createDataFrame([("i", "aa bb cc dd")], "item_id string, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = decontaminate.removed(docs, items, 3)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        assert kept.dtypes == docs.dtypes
        want = docs.where("coalesce(text, '') not like '%aa%'")
        assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))
        # A text that is no string, and a table of texts alone.
        numbers = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "doc_id bigint, text int")
        five = spark.createDataFrame([("i", "5")], "item_id string, text string")
        assert sorted(map(tuple, decontaminate.removed(numbers, five).collect())) == [(2, None), (3, 6)]
        assert {r.text for r in decontaminate.removed(docs.select("text"), items, 3).collect()} == {"a clean one", "also clean", None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
