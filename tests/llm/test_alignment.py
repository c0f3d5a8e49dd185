import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tomeweave.llm import alignment
from tomeweave.llm.queries import BYTE_LEVEL, VOCABULARY

FILES = tuple(open(p, "rb").read() for p in (BYTE_LEVEL, VOCABULARY))
PAIR = alignment.loaded((*FILES, False))
QUICK = alignment.loaded((*FILES, alignment.merges_follow_ids(FILES[0])))


def plain(texts):
    """Rows of the contract for whole texts, by sets and loops."""
    every, held = [], defaultdict(int)
    for text in texts:
        groups = []
        raw = b" " + (text or "").encode()
        if text:
            a, b = PAIR.encode_a([" " + text])[0], PAIR.b.encode(text)
            if b"".join(PAIR.raw_a[k] for k in a) == raw == b"".join(PAIR.raw_b[k] for k in b):
                ends = [np.cumsum([len(t[k]) for k in ids]).tolist() for t, ids in ((PAIR.raw_a, a), (PAIR.raw_b, b))]
                i = j = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        for pair in links:
            held[pair] += 1
        every.append((groups, links))
    top = defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    rows = []
    for groups, links in every:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for pair, n in links.items() if held[pair] == top[pair[0]]), sum(n * held[pair] for pair, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return rows


TEXTS = [
    "The cat sat on the mat, and the dog didn't.", "  two  spaces\n\nand lines\t tab ", "naïve façade — 日本語 テキスト 😀👍 ñandú", "a▁b marker", "", None, "x",
    "http://example.com/a?b=c&d=%20 0x41 <0x41> <s> </s> <unk> <|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "The cat sat on the mat, and the dog didn't.", "Ⅷ ﬁ ½ Å",
    "mixed space　wide  em", "9999999999 3.14159 +1 (555) 010-9999",
]


def long_text(seed, words=400):
    rng = random.Random(seed)
    pool = " ".join(t for t in TEXTS if t and "▁" not in t).split(" ")
    return " ".join(rng.choice(pool) for _ in range(words))


def test_both_libraries_give_the_same_ids():
    assert alignment.merges_follow_ids(FILES[0])
    broken = json.loads(FILES[0])
    broken["model"]["merges"][5:7] = broken["model"]["merges"][6:4:-1]
    assert not alignment.merges_follow_ids(json.dumps(broken).encode())
    # One character of every block of 16, in places where it begins, ends and splits words.
    signs = [chr(c) for c in range(0, 0x110000, 16) if not 0xD800 <= c < 0xE000]
    texts = [f" a{c} {c}{c}1{c}!{c}  {c}'s{c}" for c in signs] + [" " + t for t in [*TEXTS, long_text(9, 3000)] if t]
    assert PAIR.encode_a(texts) == QUICK.encode_a(texts)


@pytest.mark.parametrize("size", [1, 7, 64, 333, 100_000])
def test_ranges_compose_to_the_whole(size):
    for text in [*TEXTS, long_text(1, 60), "no-cut-" * 40, " lead", "trail ", "a b"]:
        if not text or (size == 1 and len(text) > 120):
            continue
        raw = b" " + text.encode()
        whole = next(PAIR.fragments([(raw, 0, 0, len(raw))]))
        parts = list(PAIR.fragments(list(alignment.ranges_of(raw, size))))
        got = alignment.compose(parts)
        assert got.ok == whole.ok
        if whole.ok:
            for name in ("a", "b", "ga", "gb"):
                assert getattr(got, name).tolist() == getattr(whole, name).tolist(), (text, name)


def test_monoid():
    raw = b" " + long_text(3, 50).encode()
    parts = list(PAIR.fragments(list(alignment.ranges_of(raw, 3))))
    assert any(len(p.ga) == 1 for p in parts) and any(len(p.ga) > 2 for p in parts)
    rng = random.Random(2)
    want = alignment.compose(parts)
    for _ in range(20):
        tree = [alignment.EMPTY, *parts, alignment.EMPTY]
        while len(tree) > 1:
            k = rng.randrange(len(tree) - 1)
            tree[k : k + 2] = [alignment.compose(tree[k : k + 2])]
        assert all(getattr(tree[0], n).tolist() == getattr(want, n).tolist() for n in ("a", "b", "ga", "gb"))


@pytest.mark.parametrize("hot,chunk", [(1 << 18, 65_536), (40, 300), (0, 50)])
def test_against_loops(spark, hot, chunk):
    texts = [*TEXTS, long_text(5), long_text(5), long_text(6, 900)]
    df = spark.createDataFrame([(k if k % 5 else None, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    df = df.selectExpr("*", "1 as a", "'x' as _row", "2 as ok", "3 as k").repartition(4)
    got = alignment.align(alignment.link(df, BYTE_LEVEL, VOCABULARY, chunk), hot)
    want = [(k if k % 5 else None, *row) for k, row in enumerate(plain(texts))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert alignment.align(alignment.link(df.limit(0), BYTE_LEVEL, VOCABULARY, chunk), hot).count() == 0


def test_encode_gives_the_tokens(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, long_text(8)])], "doc_id bigint, text string")
    for chunk in (100, 65_536):
        for row in alignment.encode(df, BYTE_LEVEL, VOCABULARY, chunk).collect():
            text = [*TEXTS, long_text(8)][row.doc_id] or ""
            assert row.ok == bool(text and "▁" not in text)
            if row.ok:
                assert b"".join(PAIR.raw_a[k] for k in row.a) == b" " + text.encode() == b"".join(PAIR.raw_b[k] for k in row.b)
                assert (sum(row.ga), sum(row.gb), row.ga[-1], row.gb[-1]) == (len(row.a), len(row.b), 0, 0)


def test_groups_with_very_many_links(monkeypatch, spark):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 6)
    rng = np.random.default_rng(4)
    rows, want = [], Counter()
    for r in range(5):
        ga, gb = rng.integers(1, 6, 3), rng.integers(1, 6, 3)
        a, b = rng.integers(0, 4, ga.sum()), rng.integers(0, 4, gb.sum())
        rows.append(alignment.Fragment(*(x.astype(np.int32) for x in (a, b, np.append(ga, 0), np.append(gb, 0)))))
        i = j = 0
        for x, y in zip(ga, gb, strict=True):
            want.update((r, int(p) << 20 | int(q)) for p in a[i : i + x] for q in b[j : j + y])
            i, j = i + x, j + y
    row, code, times = alignment.Groups(alignment._records(rows)).pairs()
    assert dict(zip(zip(row.tolist(), code.tolist(), strict=True), times.tolist(), strict=True)) == want


def test_pairs_are_told_some_rows_at_a_time(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(alignment, "BLOCK_LINKS", 64)
    codes = [list(range(k, k + 5)) for k in range(40)] + [[], list(range(30))]
    ints = pa.array(range(len(codes)), pa.int64())
    lists = [pa.array(codes, pa.list_(pa.int64())), pa.array([[2] * len(c) for c in codes], pa.list_(pa.int32()))]
    names = [*alignment.KEPT, "codes", "times"]
    batch = pa.RecordBatch.from_arrays([ints if n != "groups_sha256" else ints.cast(pa.string()) for n in names[:-2]] + lists, names)
    table = SimpleNamespace(value=(np.arange(0, 20), np.arange(0, 20) + 1, np.arange(20) % 2 == 0))
    parts = list(alignment._told(table)(iter([batch, batch.slice(0, 0)])))
    # A batch holds 64 MB of pairs: no more than a few rows of them may be expanded at once.
    assert all(p.num_rows == 1 or len(p.column("_codes").flatten()) <= 8 for p in parts)
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(len(codes)))
    for row, own in zip(rows, codes, strict=True):
        assert row["count_sum"] == sum(2 * (c + 1) for c in own if c < 20) and row["n_best"] == sum(2 for c in own if c < 20 and c % 2 == 0)
        assert row["_codes"] == [c for c in own if c >= 20] and row["_times"] == [2] * len(row["_codes"])
