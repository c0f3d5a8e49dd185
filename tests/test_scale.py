"""Blocked windows must equal plain windows, whatever the block size and however hot a group is."""

import random

import pytest
from pyspark.sql import functions as F

from tomeweave.scale import OrderBlocks, broadcast_if_small, forward_fill, plan_blocks, row_index, rows_named, running_sums, spread


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        group = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        rows.append((i, group, rng.randint(1, 9), rng.choice([None, None, None, f"v{i}"])))
    return spark.createDataFrame(rows, "pos long, grp string, n long, val string").cache()


def expected(rows):
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: r.pos):
        total, last, index = state.get(r.grp, (0, None, -1))
        state[r.grp] = (total + r.n, r.val or last, index + 1)
        out[r.pos] = state[r.grp]
    return out


@pytest.mark.parametrize("rows_per_block", [7, 100, 10_000])
def test_running_fill_and_index(hot, rows_per_block):
    want = expected(hot.collect())
    sums = running_sums(hot, ["grp"], ["pos"], {"total": F.col("n")}, rows_per_block=rows_per_block)
    assert {r.pos: r.total for r in sums.collect()} == {k: v[0] for k, v in want.items()}
    filled = forward_fill(hot, ["grp"], ["pos"], F.col("val"), "last", rows_per_block=rows_per_block)
    assert {r.pos: r["last"] for r in filled.collect()} == {k: v[1] for k, v in want.items()}
    numbered = row_index(hot, ["grp"], ["pos"], "at", rows_per_block=rows_per_block)
    assert {r.pos: r["at"] for r in numbered.collect()} == {k: v[2] for k, v in want.items()}


def test_no_group(hot):
    numbered = row_index(hot, [], ["pos"], "at", rows_per_block=50)
    assert all(r.pos == r["at"] for r in numbered.collect())


def test_blocked_window_keeps_rows_of_a_hot_group_apart(hot):
    blocks = plan_blocks(hot, "pos", 100)
    assert len(blocks.bounds) >= 7
    sizes = [r["count"] for r in hot.groupBy("grp", blocks.of(F.col("pos")).alias("b")).count().collect()]
    assert max(sizes) < 150


def test_small_inputs_take_blocks_too(hot):
    assert len(plan_blocks(hot, "pos").bounds) == 7
    assert len(plan_blocks(hot.limit(3), "pos").bounds) <= 2 and plan_blocks(hot.limit(0), "pos").bounds == ()


def test_block_search(spark):
    bounds = OrderBlocks((3, 10, 11, 40))
    df = spark.range(0, 50).withColumn("b", bounds.of(F.col("id")))
    for r in df.collect():
        assert r.b == sum(x <= r.id for x in bounds.bounds)
    assert spark.range(3).select(OrderBlocks().of(F.col("id")).alias("b")).distinct().count() == 1


def test_string_blocks(spark):
    df = spark.range(0, 1000).select(F.format_string("c_%05d", "id").alias("k"))
    blocks = plan_blocks(df, "k", 100)
    assert blocks.bounds
    numbered = row_index(df, [], ["k"], "at", blocks)
    assert all(int(r.k[2:]) == r["at"] for r in numbered.collect())


def test_block_key_type(spark):
    with pytest.raises(TypeError):
        plan_blocks(spark.range(10).select(F.current_timestamp().alias("t")), "t", 2)


def test_broadcast_only_when_small(spark):
    small, large = spark.range(10), spark.range(100_000_000)
    joined = lambda d: d.hint("x")._jdf.queryExecution().optimizedPlan().toString()
    assert broadcast_if_small(small) is not small
    assert broadcast_if_small(large) is large
    assert joined(small)


def test_spread_moves_only_small_inputs(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.range(100).repartition(16).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert spread(many, "id") is many


@pytest.mark.parametrize("kind", ["long", "string"])
def test_one_value_with_half_of_all_rows_is_several_blocks(spark, kind):
    rng = random.Random(9)
    rows = [(g, 50 if rng.random() < 0.5 else rng.randint(0, 99), i, rng.randint(1, 9)) for i, g in enumerate(rng.choices(["hot", "a"], [9, 1], k=1000))]
    df = spark.createDataFrame(rows, "grp string, at long, id long, n long")
    df = df.select("grp", F.lpad(F.col("at").cast("string"), 3, "0").alias("at") if kind == "string" else "at", "id", "n").repartition(5)
    blocks = plan_blocks(df, "at", 50, tie="id")
    sizes = {r["b"]: r["count"] for r in df.groupBy(blocks.of(F.col("at"), F.col("id")).alias("b")).count().collect()}
    at_fifty = df.where(F.col("at") == ("050" if kind == "string" else 50)).select(blocks.of(F.col("at"), F.col("id")).alias("b")).distinct().count()
    assert at_fifty >= 8 and max(sizes.values()) <= 150
    want, state = {}, {}
    for g, _, i, n in sorted(rows, key=lambda r: (r[1], r[2])):
        state[g] = state.get(g, 0) + n
        want[i] = state[g]
    for per_block in (30, 10_000):
        got = running_sums(df, ["grp"], ["at", "id"], {"total": F.col("n")}, rows_per_block=per_block)
        assert {r.id: r.total for r in got.collect()} == want
        numbered = row_index(df, [], ["at", "id"], "pos", rows_per_block=per_block).orderBy("pos").collect()
        assert [r.id for r in numbered] == [i for _, _, i, _ in sorted(rows, key=lambda r: (r[1], r[2]))]


def test_rows_named_by_many_ids_are_not_shuffled(spark):
    far = [0, 1, 7, 8, 9, 32_767, 32_768, 32_769, 65_536, 1 << 33, (1 << 33) + 5, (1 << 40) + 32_768, -1, -32_768]
    asked = [*far[::2], far[0], *range(100_000, 100_600, 3)]
    rows = [(k, f"t{k}") for k in [*far, *far[:3], *range(99_990, 100_610), None]]
    df = spark.createDataFrame(rows, "node bigint, text string")
    ids = spark.createDataFrame([(k,) for k in asked], "node bigint")
    want = sorted(r for r in rows if r[0] in set(asked))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for limit, bitmaps, shuffled in ((10**6, 0, False), (10, 100, False), (10, 2, True)):
            for named in (True, False):
                out = rows_named(df, ids, "node", named, limit, bitmaps)
                got = sorted(map(tuple, out.collect()), key=str)
                assert got == sorted(want if named else [r for r in rows if r[0] not in set(asked)], key=str)
                assert out.columns == df.columns and ("SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()) == shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
