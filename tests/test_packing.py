"""Packing against a direct sequential packer."""

import math
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tomeweave.functions.policy import safe_limit
from tomeweave.operators import packing

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tokens(text):
    return math.ceil(len(text) / 4)


def pack_directly(texts, limit, separator="\n\n"):
    """(number, text, members) of every emitted section, one text after the other."""
    out, number, held, members, cost = [], 1, "", [], 0

    def emit(text, names):
        if text.strip():
            out.append((number, text, names))

    for name, text in texts:
        if not text:
            continue
        if tokens(text) > limit:
            if held:
                emit(held, members)
                number += 1
            held, members, cost = "", [], 0
            part, used = "", 0
            for para in text.split(separator):
                c = tokens(para) + 1
                if used + c > limit:
                    emit(part, [name])
                    number += 1
                    part, used = "", 0
                part += para + separator
                used += c
            emit(part, [name])
            number += 1
        elif cost + tokens(text) > limit:
            emit(held, members)
            number += 1
            held, members, cost = text, [name], tokens(text)
        else:
            held = held + "\n\n" + text if held else text
            members = members + [name]
            cost += tokens(text)
    if held:
        emit(held, members)
    return out


def corpus(seed, n=120, big=0.08):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < big:
            paras = ["p" * rng.choice([3, 20, 60, 400]) for _ in range(rng.randint(2, 12))]
            text = "\n\n".join(paras)
        else:
            text = "x" * rng.choice([0, 1, 4, 17, 40, 80])
        rows.append((rng.choice(["s", "s", "t"]), i, f"b{i}", text))
    return rows


@pytest.mark.parametrize("seed,rows_per_block", [(1, 5), (2, 11), (3, 40), (4, 100_000)])
def test_sections_equal_direct_packing(spark, seed, rows_per_block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "series string, pos long, book string, text string")
    got = packing.sections(df, "series", "pos", "book", 50, rows_per_block=rows_per_block).collect()
    for series in ("s", "t"):
        want = pack_directly([(b, t) for s, _, b, t in rows if s == series], 50)
        mine = sorted((r.section, r.text_content, list(r.included_books)) for r in got if r.series == series)
        assert mine == sorted(want)
    for r in got:
        assert r.chunk_id == f"{r.series}_section_{r.section:02d}"
        assert r.token_count == tokens(r.text_content) and r.character_count == len(r.text_content)


@pytest.mark.parametrize("rows_per_block", [3, 17, 100_000])
def test_pack_of_a_hot_group(spark, rows_per_block):
    rng = random.Random(9)
    rows = [("hot", i, rng.randint(1, 30)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, pos long, cost long")
    got = {r.pos: r.section for r in packing.pack(df, ["g"], "pos", F.col("cost"), 25, rows_per_block=rows_per_block).collect()}
    number, held = 1, 0
    for _, pos, cost in rows:
        if held and held + cost > 25:
            number, held = number + 1, 0
        held += cost
        assert got[pos] == number


def test_edges_of_the_budget():
    label = lambda costs: packing.label_run(np.array(costs), np.full(len(costs), -1), 10, 0, 1)[0].tolist()
    assert label([4, 6]) == [1, 1]
    assert label([4, 7]) == [1, 2]
    assert label([10, 1, 9, 1]) == [1, 2, 2, 3]
    assert safe_limit(1000, 0.1) == 900


def test_unmarked_oversized_text_is_refused():
    with pytest.raises(ValueError):
        packing.label_run(np.array([11]), np.array([-1]), 10, 0, 1)


def test_oversized_first_last_between():
    costs, bursts = np.array([30, 4, 30, 4, 30]), np.array([3, -1, 3, -1, 3])
    labels, filled, number = packing.label_run(costs, bursts, 10, 0, 1)
    assert labels.tolist() == [1, 4, 5, 8, 9] and filled == 0 and number == 12


@pytest.mark.parametrize("seed", range(6))
def test_transfer_tables_compose(seed):
    rng = random.Random(seed)
    n = 60
    costs = np.array([rng.randint(1, 10) for _ in range(n)])
    bursts = np.full(n, -1)
    for i in range(n):
        if rng.random() < 0.1:
            costs[i], bursts[i] = 50, rng.randint(1, 4)
    for filled in range(0, 11):
        _, fill, number = packing.label_run(costs, bursts, 10, filled, 5)
        table = packing.transfer_table(costs, bursts, 10)
        assert packing.apply_table(table, 10, filled, 5) == (fill, number)


def byte_encoding():
    import tiktoken

    return tiktoken.Encoding(
        name="bytes", pat_str=r"(?s).", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}
    )


def test_tables_compose():
    rng = random.Random(12)
    for limit in (5, 12, 40):
        for _ in range(60):
            costs = [rng.choice([1, 2, 3, 7, limit, limit + 3]) for _ in range(rng.randint(2, 14))]
            bursts = [packing.NORMAL if c <= limit else rng.randint(1, 3) for c in costs]
            cuts = sorted({0, len(costs), *[rng.randrange(1, len(costs)) for _ in range(3)]})
            tables = [packing.transfer_table(np.array(costs[a:b]), np.array(bursts[a:b]), limit) for a, b in zip(cuts, cuts[1:], strict=False)]
            while len(tables) > 1:
                k = rng.randrange(len(tables) - 1)
                tables[k : k + 2] = [packing.compose_tables(tables[k], tables[k + 1], limit)]
            whole = packing.transfer_table(np.array(costs), np.array(bursts), limit)
            for filled in range(limit + 1):
                want = packing.label_run(np.array(costs), np.array(bursts), limit, filled, 4)[1:]
                assert packing.apply_table(tables[0], limit, filled, 4) == want == packing.apply_table(whole, limit, filled, 4), (costs, bursts, filled)


@pytest.mark.parametrize("group", [["g"], []])
def test_a_tree_of_blocks_equals_one_pass(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else "b", k, rng.choice([1, 2, 5, 9, 30])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, at long, c long").repartition(4)
    got = {r["at"]: r.section for r in packing.pack(df, group, "at", F.col("c"), 20, F.lit(2), rows_per_block=9).collect()}
    for name in {r[0] for r in rows} if group else [None]:
        part = [r for r in rows if name in (None, r[0])]
        costs = np.array([r[2] for r in part])
        labels, _, _ = packing.label_run(costs, np.where(costs > 20, 2, packing.NORMAL), 20, 0, 1)
        assert [got[r[1]] for r in part] == labels.tolist()
