import base64
import hashlib
import os

import numpy as np
import pytest

from tomeweave.llm import sentencepieces, urlfilter, warc
from tomeweave.llm.queries import HOST_RULES, VOCABULARY
from tomeweave.session import scratch_path


# ----------------------------------------------------------------- archive
def test_archive_round_trip(spark):
    rows = [(3, "http://a/é\r\nX: y", "ñ payload"), (1, None, "ñ payload"), (2, "u", None), (5, "u", ""), (None, "v", "alone"), (7, "w", "x" * 200_000), (8, "z", "WARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'q' as header", "1 as address")
    path = scratch_path(spark, "archive")
    warc.write_archive(pages, path)
    got = {r.page_id: r for r in warc.index(spark, path).collect()}
    for key, _, html in rows:
        data = (html or "").encode()
        assert got[key].payload_bytes == len(data)
        assert got[key].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), None: ("response", None), 7: ("response", None), 8: ("response", None)
    }
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    for r in warc.records(spark, path).collect():
        assert r.payload == (dict((k, h) for k, _, h in rows)[r.page_id] or "")
        assert r.record == r.header + (r.payload if r.record_type == "response" else "") + "\r\n\r\n"
    warc.write_archive(pages, path + "-large", min_bytes=1_000)
    assert {r.record_type for r in warc.index(spark, path + "-large").collect()} == {"response"}
    warc.write_archive(pages.limit(0), path + "-none")
    assert warc.index(spark, path + "-none").count() == 0


def test_a_changed_payload_is_noticed(spark):
    path = scratch_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "a")], "page_id bigint, url string, html string"), path)
    stored = spark.read.parquet(f"{path}/payloads").selectExpr("address", "first_id", "'b' as payload").collect()
    spark.createDataFrame(stored, "address string, first_id bigint, payload string").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.index(spark, path).collect()


# -------------------------------------------------------------------- urls
def test_url_rules(spark):
    cases = {
        "http://Example.COM/en/1?x#y": ("example.com", "/en/1", "example.com/en/", "block"), "https://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"), "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://x.net/EN/": ("x.net", "/EN/", None, "allow"), "http://free-bets.org/": ("free-bets.org", "/", None, "block"), "http://carefree-bets.org/": ("carefree-bets.org", "/", None, "allow"),
        "http://x.com": ("x.com", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"), "http://a.org/x/CASINO/y": ("a.org", "/x/CASINO/y", None, "block"), "http://É.org?q": ("É.org", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, 1, 2) for k, u in enumerate(cases)], "page_id bigint, url string, verdict int, token int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, HOST_RULES).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urlfilter.judge(pages.limit(0), HOST_RULES).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rule = urlfilter.host_rule("block", "news.example.com/en/")
    index = urlfilter.Index([rule], {"news": 5, "example": 90, "com": 100, "en": 60})
    assert index.by_token == {"news": [0]}
    assert urlfilter.host_rule("block", "a.com/pre").literals == ("a", "com")


# ------------------------------------------------------------------ pieces
def small_vocabulary():
    texts = [b"", *[bytes([c]) for c in range(256)], b" ", b" a", b"a", b"ab", b"b", b" ab", b"abc", b"  ", "é".encode(), b"c d"[:1]]
    kinds = [sentencepieces.UNKNOWN, *[sentencepieces.BYTE] * 256, *[sentencepieces.NORMAL] * (len(texts) - 257)]
    scores = np.zeros(len(texts))
    scores[257:] = [-3.0, -2.5, -2.0, -2.2, -2.1, -4.0, -6.5, -5.0, -3.0, -2.0]
    return sentencepieces.Vocabulary(texts, scores, kinds)


def best_score(text, vocab):
    """Over all segmentations, by trying every end of the last piece."""
    chars = [c.encode() for c in text]
    known = {t: k for k, t in enumerate(vocab.texts) if vocab.kinds[k] == sentencepieces.NORMAL}
    best = [0.0]
    for end in range(1, len(chars) + 1):
        options = []
        for start in range(end):
            part = b"".join(chars[start:end])
            if part in known:
                options.append(best[start] + vocab.scores[known[part]])
            elif end - start == 1:
                options.append(best[start] + vocab.unknown_score)
        best.append(max(options))
    return best[-1]


def score_of(ids, vocab):
    total, left = 0.0, 0
    for k in ids:
        if vocab.kinds[k] == sentencepieces.BYTE:
            byte = vocab.texts[k][0]
            if left == 0:
                total, left = total + vocab.unknown_score, sentencepieces.char_bytes(byte)
            left -= 1
        else:
            total += vocab.scores[k]
    return total


def test_segmentations_are_best():
    vocab = small_vocabulary()
    rng = np.random.default_rng(1)
    texts = ["", "a", "abcab", "zz", "é😀a"] + ["".join(rng.choice(list("abc é▁\n"), 12)) for _ in range(60)]
    counts, ids = sentencepieces.Encoder(vocab).encode(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        mine = ids[a:b].tolist()
        assert b"".join(vocab.texts[k] for k in mine) == ((" " + text).encode() if text else b"")
        assert not text or abs(score_of(mine, vocab) - best_score(" " + text, vocab)) < 1e-9
        assert not text or mine == sentencepieces.segment_one((" " + text).encode(), vocab) or abs(score_of(mine, vocab) - best_score(" " + text, vocab)) < 1e-9


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_round_trip(odd_docs, no_docs):
    vocab = sentencepieces.load(VOCABULARY)
    found = sentencepieces.encode(odd_docs, vocab, keep=("text",))
    rows = sentencepieces.decode(found, vocab).collect()
    assert len(rows) == odd_docs.count() and all(r.decoded == (r.text or "") for r in rows)
    assert sentencepieces.decode(sentencepieces.encode(no_docs, vocab), vocab).count() == 0
    wild = odd_docs.sparkSession.createDataFrame([(1, [-5, 10**6, 3 + 255]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert [r.decoded for r in sentencepieces.decode(wild, vocab).orderBy("doc_id").collect()] == ["�", None, ""]
