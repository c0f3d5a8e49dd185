"""Order-dependent operators that do not put a whole group into one task.

A window partitioned by book, series or API key sends that key's every row to
one task. Here each group is cut into *order blocks* first: contiguous ranges of
the ordering key whose bounds come from a bounded statistic (approximate
quantiles or a bounded sample). One small total per (group, block) is carried
across the blocks of its group and placed in front of each block, and the heavy
window then runs per (group, block) with that start.
Bounds steer only the balance of the work, never the result, and since they are
plain literals in the plan a recomputed task always produces the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.session import cut_lineage

ROWS_PER_BLOCK = 250_000
MAX_BLOCKS = 65_536
BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024
# Rows of a written table that may be broadcast: counted, not estimated, before the hint is given.
BROADCAST_ROWS = 200_000
# Bitmaps that may be broadcast, of 4 KB and 32,768 ids in a row each.
BROADCAST_BITMAPS = 8_192
USUAL_SPLIT_BYTES = 128 * 1024 * 1024
BLOCK = "_block"
LEAD = "_lead"


@dataclass(frozen=True)
class OrderBlocks:
    """Sorted inner bounds of the ordering key; ``n`` bounds make ``n + 1`` blocks.

    A value that very many rows share is cut further by a second key: ``ties`` then
    has that bound's second key, and null for bounds at the first row of their value.
    """

    bounds: tuple = field(default=())
    ties: tuple = field(default=())

    def of(self, key: Column, tie: Column | None = None) -> Column:
        """Number of bounds that are <= (key, tie), by a binary search inside the JVM."""
        n = len(self.bounds)
        if n == 0:
            return F.lit(0)
        table = F.array(*[F.lit(b) for b in self.bounds])
        cut = any(t is not None for t in self.ties)
        seconds = F.array(*[F.lit(t) for t in self.ties]) if cut else None
        steps = []
        step = 1 << (n.bit_length() - 1)
        while step:
            steps.append(F.lit(step))
            step >>= 1

        def reached(at: Column) -> Column:
            first = F.get(table, at)
            if not cut:
                return first <= key
            second = F.get(seconds, at)
            inside = second.isNull() if tie is None else second.isNull() | F.coalesce(second <= tie, F.lit(False))
            return (first < key) | ((first == key) & inside)

        return F.aggregate(
            F.array(*steps),
            F.lit(0),
            lambda low, width: F.when((low + width <= n) & reached(low + width - 1), low + width).otherwise(low),
        )


def _cuts(df: DataFrame, key: str, wanted: int, rows: int) -> list:
    """``wanted - 1`` values of ``key`` that cut its rows into about equal parts; a value may come several times."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.NumericType):
        shares = [i / wanted for i in range(1, wanted)]
        return df.agg(F.percentile_approx(F.col(key), shares, max(10_000, 4 * wanted)).alias("q")).first()["q"] or []
    if isinstance(kind, T.StringType):
        share = min(1.0, 20.0 * wanted / rows)
        seen = sorted(
            r[0] for r in df.select(key).where(F.col(key).isNotNull()).sample(share, seed=11).collect()
        )
        return [seen[i * len(seen) // wanted] for i in range(1, wanted)] if seen else []
    raise TypeError(f"block key {key!r} must be numeric or string, not {kind.simpleString()}")


def plan_blocks(
    df: DataFrame,
    key: str,
    rows_per_block: int = ROWS_PER_BLOCK,
    max_blocks: int = MAX_BLOCKS,
    at_least: int | None = None,
    tie: str | None = None,
) -> OrderBlocks:
    """Choose block bounds for ``key``; what reaches the driver is at most ``max_blocks`` values.

    There are ``at_least`` blocks (by default one for each core) however few the
    rows are, so small inputs take the way that large ones take. Rows with one
    value of ``key`` are told apart by ``tie``, the next ordering key, where the value has
    more rows than a block; without it they stay in one block.
    """
    rows = df.select(key).count()
    least = df.sparkSession.sparkContext.defaultParallelism if at_least is None else at_least
    wanted = min(max_blocks, max(least, -(-rows // rows_per_block)), rows)
    if wanted <= 1:
        return OrderBlocks()
    cuts = sorted(_cuts(df, key, wanted, rows))
    plain = sorted(set(cuts))
    if tie is None or len(plain) == len(cuts):
        return OrderBlocks(tuple(plain))
    # A value that is several cuts has that many blocks of rows, and is cut by its second key.
    heavy = {v: cuts.count(v) for v in plain if cuts.count(v) > 1}
    bounds = {(v, None) for v in plain}
    for value, parts in heavy.items():
        inside = df.where(F.col(key) == F.lit(value)).select(tie)
        bounds |= {(value, t) for t in _cuts(inside, tie, parts + 1, max(1, rows * (parts + 1) // wanted))}
    # Null second keys come first, as the window's order has them.
    ordered = sorted(bounds, key=lambda b: (b[0], b[1] is not None, b[1] if b[1] is not None else 0))
    return OrderBlocks(tuple(b for b, _ in ordered), tuple(t for _, t in ordered))


def _tie(order: Sequence[str], df: DataFrame) -> str | None:
    """The second ordering key, if blocks can be cut by it."""
    kind = df.schema[order[1]].dataType if len(order) > 1 else None
    return order[1] if isinstance(kind, (T.NumericType, T.StringType)) else None


def _block(blocks: OrderBlocks, order: Sequence[str]) -> Column:
    return blocks.of(F.col(order[0]), F.col(order[1]) if len(order) > 1 else None)


def _lead_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(LEAD, *order).rowsBetween(Window.unboundedPreceding, 0)


def _with_lead_rows(tagged: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows of every (group, block) behind one extra row that brings in the carry of the blocks before.

    The carry thus enters the window through a union: the rows are shuffled once,
    for the window, and never joined.
    """
    return tagged.withColumn(LEAD, F.lit(1)).unionByName(
        carry.withColumn(LEAD, F.lit(0)), allowMissingColumns=True
    )


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    blocks: OrderBlocks | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add inclusive running sums per group in ``order``; ``order[0]`` is the block key."""
    blocks = plan_blocks(df, order[0], rows_per_block, tie=_tie(order, df)) if blocks is None else blocks
    keys = [*group, BLOCK]
    values = {f"_part_{n}": c for n, c in sums.items()}
    tagged = df.withColumns({BLOCK: _block(blocks, order), **values})
    totals = tagged.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, *[F.sum(v).over(before).alias(v) for v in values])
    span = _lead_window(keys, order)
    return (
        _with_lead_rows(tagged, carry)
        .withColumns({n: F.sum(f"_part_{n}").over(span) for n in sums})
        .where(F.col(LEAD) == 1)
        .drop(BLOCK, LEAD, *values)
    )


def row_index(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "row_index",
    blocks: OrderBlocks | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add the 0-based position of each row within its group."""
    counted = running_sums(df, group, order, {name: F.lit(1).cast("bigint")}, blocks, rows_per_block)
    return counted.withColumn(name, F.col(name) - 1)


def forward_fill(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    blocks: OrderBlocks | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add the last non-null ``value`` at or before each row of its group."""
    blocks = plan_blocks(df, order[0], rows_per_block, tie=_tie(order, df)) if blocks is None else blocks
    keys = [*group, BLOCK]
    tagged = df.withColumns({BLOCK: _block(blocks, order), "_value": value})
    # Blocks without a value of their own still hand on what came before them.
    totals = tagged.groupBy(*keys).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_value")
    )
    before = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, F.last("_value", ignorenulls=True).over(before).alias("_value"))
    return (
        _with_lead_rows(tagged, carry)
        .withColumn(name, F.last("_value", ignorenulls=True).over(_lead_window(keys, order)))
        .where(F.col(LEAD) == 1)
        .drop(BLOCK, LEAD, "_value")
    )


def once(array: Column) -> Column:
    """An array to explode that is costly to compute.

    From ``explode(column)`` Catalyst infers a filter on the column's size and
    pushes it down, where the column is computed a second time just to be
    counted. It does not do so for an expression, and this one is the array itself.
    """
    return F.filter(array, lambda _: F.lit(True))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of a DataFrame; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only while the estimate is below ``limit``; else leave it to the shuffle join."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def broadcast_counted(written: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a written table of narrow rows while its counted rows stay within ``limit``."""
    return F.broadcast(written) if written.limit(limit + 1).count() <= limit else written


def rows_named(df: DataFrame, written: DataFrame, key: str, named: bool = True, limit: int = BROADCAST_ROWS, bitmaps: int = BROADCAST_BITMAPS) -> DataFrame:
    """The wide rows of ``df`` whose long ``key`` is (or, if not ``named``, is not) in the written one-column table of ids, without a shuffle of ``df`` while that can be.

    A few ids are broadcast themselves. More are broadcast as bitmaps, counted too, which ids that run on,
    as ``monotonically_increasing_id`` gives them, fill at about a bit each. Only ids beyond both limits meet ``df`` in a shuffle.
    """
    how = "left_semi" if named else "left_anti"
    if written.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(written), key, how)
    # One id table's rows of a bitmap come together first, so that no task makes a bitmap of a few ids for every other one.
    dealt = written.where(F.col(key).isNotNull()).select(F.bitmap_bucket_number(key).alias("_bucket"), F.bitmap_bit_position(key).alias("_at"))
    bits = cut_lineage(dealt.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits")), "bitmaps")
    if bits.limit(bitmaps + 1).count() > bitmaps:
        return df.join(written, key, how)
    at = F.bitmap_bit_position(key).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))
    met = df.join(F.broadcast(bits), F.bitmap_bucket_number(key) == F.col("_bucket"), "inner" if named else "left")
    return met.where(there if named else ~there).select(*df.columns)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a part of a small, badly split input before heavy per-row work.

    A file with one row group is one task however many cores wait. Only inputs
    below one usual split per core, in fewer files than cores, are moved; larger
    ones have splits enough and are left alone. ``key`` should be unique.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if estimated_bytes(df) >= cores * USUAL_SPLIT_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, key)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Bring a result that must be small to the driver, and refuse when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
