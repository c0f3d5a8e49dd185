"""Secrets behind long names, without any name, and short ones behind a name."""

import base64
import hashlib
import random

import pytest

from tomeweave.llm import secrets

HEX = hashlib.sha1(b"one").hexdigest()
MIXED = base64.b64encode(hashlib.sha256(b"two").digest()).decode().replace("=", "")[:40]
ALNUM = "".join(c for c in base64.b64encode(hashlib.sha512(b"three").digest()).decode() if c.isalnum())


@pytest.fixture(scope="module")
def ready(spark):
    at = random.Random(3)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    words = ["".join(at.choice(parts) for _ in range(at.randint(1, 5))) for _ in range(900)]
    docs = spark.createDataFrame([(k, " ".join(at.choice(words) for _ in range(120))) for k in range(400)], "doc_id bigint, text string")
    return secrets.prepared(docs)


def found(spark, ready, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: [c.value for c in r.secrets] for r in secrets.scan(docs, *ready).collect()}


def test_long_names_do_not_hide_their_values(spark, ready):
    pairs = [
        (f"aws_secret_access_key={MIXED} then", MIXED), (f'aws_secret_access_key = "{MIXED}"', MIXED), (f'PRODUCTION_API_TOKEN="{HEX}"', HEX),
        (f"production_database_password: {HEX}", HEX), (f"GITHUB_PERSONAL_ACCESS_TOKEN='{HEX}'", HEX),
    ]
    assert found(spark, ready, [t for t, _ in pairs]) == {k: [v] for k, (_, v) in enumerate(pairs)}


def test_context_is_the_text_itself(spark, monkeypatch):
    text = f"é lead aws_secret_access_key={MIXED} {HEX}/x {HEX} password=ab12cd {'y' * 30} token: 'zz99zz' " + "😀 end" * 20
    seen = {}
    real = secrets.features

    def spy(value, before, after, dictionary):
        seen["columns"] = (before, after)
        return [*real(value, before, after, dictionary), before.alias("b"), after.alias("a")]

    monkeypatch.setattr(secrets, "features", spy)
    monkeypatch.setattr(secrets, "forest_score", lambda c, _: secrets.F.concat_ws("\0", c["b"], c["a"]))
    monkeypatch.setattr(secrets, "FOUND", secrets.FOUND.replace("score: double", "score: string"))
    row = secrets._scored(spark.createDataFrame([(text,)], "t string"), [], [], "t").select("_found").first()
    assert len(row._found) == 7
    for c in row._found:
        assert text[c.start : c.end] == c.value
        assert c.score.split("\0") == [text[max(0, c.start - 48) : c.start], text[c.end : c.end + 48]]


def test_secrets_without_a_name(spark, ready):
    values = [HEX, MIXED, "ghp_" + ALNUM[:36], "AKIA" + ALNUM[:16].upper()]
    texts = [f"thereon then {v} andes at" for v in values]
    assert found(spark, ready, texts) == {k: [v] for k, v in enumerate(values)}
    urls = [f"at https://api.example.com/list?key={ALNUM[:32]} on", f"Authorization: Bearer {ALNUM[:36]}\n"]
    assert found(spark, ready, urls) == {0: [ALNUM[:32]], 1: [ALNUM[:36]]}


def test_short_secrets_behind_a_name(spark, ready):
    texts = ["so password = hunter2Correct9 then", "db_password: 'x9Kq2LmZ81bT'", "no name hunter2Correct9 here"]
    assert found(spark, ready, texts) == {0: ["hunter2Correct9"], 1: ["x9Kq2LmZ81bT"], 2: []}


def test_look_alikes_stay(spark, ready):
    texts = [
        f"commit {HEX} at", f"sha256: {HEX} on", "id 123e4567-e89b-12d3-a456-426614174000 then", "token = 'there-onthe'", "password: thereon is",
        "aws_secret_access_key = os", "see /there/onan/ande/reat.html now", "=" * 50,
    ]
    assert found(spark, ready, texts) == {k: [] for k in range(len(texts))}
