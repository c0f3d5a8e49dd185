import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeweave.operators import limits
from tomeweave.streaming import jobs


@pytest.fixture(scope="module")
def requests(spark):
    rng = random.Random(1)
    rows, t = [], 0
    for i in range(500):
        t += rng.choice([0, 1, 20_000_000, 60_000_000, 3_000_000_000])
        rows.append((i, "hot" if rng.random() < 0.7 else rng.choice(["x", "y"]), t, rng.randint(1, 9)))
    return spark.createDataFrame(rows, "id long, api_key string, us long, tokens long").cache()


@pytest.mark.parametrize("rows_per_block", [40, 100_000])
def test_trailing_totals(requests, rows_per_block):
    rows = requests.collect()
    got = limits.quota_audit(requests, "api_key", "us", "id", F.col("tokens"), rpm=2, rpd=30, tpm=15, rows_per_block=rows_per_block)
    for r in got.collect():
        past = [p for p in rows if p.api_key == r.api_key and p.us <= r.us]
        minute = [p for p in past if p.us > r.us - 60_000_000]
        day = [p for p in past if p.us > r.us - 86_400_000_000]
        assert (r.minute_requests, r.day_requests, r.minute_tokens) == (len(minute), len(day), sum(p.tokens for p in minute))
        what = "refuse" if len(day) > 30 else "wait_requests" if len(minute) > 2 else "wait_tokens" if r.minute_tokens > 15 else "admit"
        assert r.decision == what
    assert got.count() == len(rows)


def admit_directly(times, tokens, quota):
    log, out = [], []
    for now, cost in zip(times, tokens):
        day = [x for x in log if x[0] > now - 86_400_000_000]
        minute = [x for x in day if x[0] > now - 60_000_000]
        if len(day) >= quota.rpd:
            out.append("refuse")
            continue
        out.append("wait_requests" if len(minute) >= quota.rpm else "wait_tokens" if sum(x[1] for x in minute) + cost > quota.tpm else "admit")
        log.append((now, cost))
    return out


def test_limiter_steps():
    rng = random.Random(3)
    times = np.cumsum([rng.choice([0, 10_000_000, 60_000_000, 2_000_000_000]) for _ in range(400)])
    tokens = np.array([rng.randint(1, 20) for _ in range(400)])
    quota = jobs.Quota(rpm=3, rpd=20, tpm=30)
    want = admit_directly(times.tolist(), tokens.tolist(), quota)
    got, log = [], np.empty((0, 2), np.int64)
    for part in range(0, 400, 37):  # state carried from call to call
        what, waits, log = jobs.admit(times[part : part + 37], tokens[part : part + 37], log, quota)
        got += what
        assert len(log) <= quota.rpd and len(waits) == len(what)
    assert got == want and {"refuse", "wait_requests", "wait_tokens", "admit"} == set(got)


def test_limiter_edges():
    quota = jobs.Quota(rpm=2, rpd=100, tpm=10)
    empty = np.empty((0, 2), np.int64)
    what, waits, _ = jobs.admit(np.array([0]), np.array([99]), empty, quota)  # first request above the token quota
    assert (what, waits) == (["wait_tokens"], [1.0])
    what, waits, _ = jobs.admit(np.array([0, 1, 60_000_000]), np.array([1, 1, 1]), empty, quota)
    assert what == ["admit", "admit", "admit"]  # the first is exactly 60 s old and no longer counts
    what, waits, _ = jobs.admit(np.array([0, 0, 30_000_000]), np.array([1, 1, 1]), empty, quota)
    assert what[2] == "wait_requests" and waits[2] == 30.0


def test_usage(spark):
    rows = [("m", 3), ("m", 4), (None, 5), ("n", 0)]
    df = spark.createDataFrame(rows, "model string, tokens long")
    got = {r.model: (r.requests, r.tokens) for r in limits.usage_summary(df, F.col("model"), F.col("tokens")).collect()}
    assert got == {"m": (2, 7), "unknown": (1, 5), "n": (1, 0), "(all)": (4, 12)}


def test_models_by_capability(spark):
    df = spark.createDataFrame([("gemini-b", ["generateContent"]), ("gemini-a", ["generateContent", "x"]), ("gemini-c", None), ("other", ["generateContent"])], "name string, acts array<string>")
    assert [r.name for r in limits.capable_models(df, "name", "acts").collect()] == ["gemini-a", "gemini-b"]


def test_streams(spark, requests, tmp_path):
    folder = str(tmp_path / "in")
    parts = requests.orderBy("us", "id").collect()
    for i in range(0, len(parts), 125):  # four files, one micro-batch each
        spark.createDataFrame(parts[i : i + 125], requests.schema).coalesce(1).write.mode("append").parquet(folder)
    arrived = jobs.file_stream(spark, folder, requests, files_per_trigger=1)
    usage = {r.model: (r.requests, r.tokens) for r in jobs.accumulate_usage(arrived, F.col("api_key"), F.col("tokens")).collect()}
    batch = {r.model: (r.requests, r.tokens) for r in limits.usage_summary(requests, F.col("api_key"), F.col("tokens")).collect()}
    assert usage == batch
    quota = jobs.Quota(rpm=2, rpd=12, tpm=12)
    got = {r.id: r.decision for r in jobs.run_to_table(jobs.limit_requests(arrived, "api_key", "id", "us", "tokens", quota), "lim").collect()}
    for k in ("hot", "x", "y"):
        mine = [p for p in parts if p.api_key == k]
        want = admit_directly([p.us for p in mine], [p.tokens for p in mine], quota)
        assert [got[p.id] for p in mine] == want
