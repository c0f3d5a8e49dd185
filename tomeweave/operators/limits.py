"""Sliding-window request quotas and the usage ledger."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.constants import REQUESTS_PER_DAY, REQUESTS_PER_MINUTE, TOKENS_PER_MINUTE
from tomeweave.scale import ROWS_PER_BLOCK, OrderBlocks, plan_blocks, running_sums

MINUTE = 60
DAY = 86_400


def trailing_totals(
    requests: DataFrame,
    key: str,
    micros: str,
    unique_id: str,
    totals: Mapping[str, tuple[int, Column]],
    blocks: OrderBlocks | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add, per entry ``name: (seconds, value)``, the sum of ``value`` over (t - seconds, t].

    A trailing total is the difference of two running totals: every time of a key
    also asks for the running total at its start of each window; events and
    questions are put in one order and summed block by block. A range window would
    add up every frame anew and keep a key in one task. Requests of one key and
    time have the same totals and are one row of all this, so a time stamp that very
    many share is folded by partial sums before anything is moved.
    """
    names = list(totals)
    sums = [F.sum(v.cast("bigint")).alias(f"_v{i}") for i, (_, v) in enumerate(totals.values())]
    moments = requests.groupBy(key, micros).agg(*sums)
    blocks = plan_blocks(moments, micros, rows_per_block) if blocks is None else blocks
    spans = sorted({0, *[seconds for seconds, _ in totals.values()]})
    lag = F.col("_span").cast("bigint") * 1_000_000
    # _span is null for the event itself, 0 for "up to now", else the window's length.
    marks = F.array(F.lit(None).cast("int"), *[F.lit(s) for s in spans])
    rows = moments.select("*", F.explode(marks).alias("_span")).select(
        key,
        micros,
        F.when(F.col("_span").isNull(), F.col(micros)).otherwise(F.col(micros) - lag).alias("_at"),
        F.col("_span").isNotNull().cast("int").alias("_asks"),
        "_span",
        *[F.when(F.col("_span").isNull(), F.col(f"_v{i}")).otherwise(0).cast("bigint").alias(f"_v{i}") for i in range(len(names))],
    )
    # Blocks are ranges of time alone: a time has few rows here.
    run = running_sums(
        rows, [key], ["_at", "_asks", micros], {f"_r{i}": F.col(f"_v{i}") for i in range(len(names))}, blocks
    ).where(F.col("_asks") == 1)
    value_at = lambda i, span: F.max(F.when(F.col("_span") == span, F.col(f"_r{i}")))
    answers = run.groupBy(key, micros).agg(
        *[(value_at(i, 0) - value_at(i, totals[n][0])).alias(n) for i, n in enumerate(names)]
    )
    answers = answers.withColumnsRenamed({key: "_key", micros: "_micros"})
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(micros).eqNullSafe(F.col("_micros"))
    return requests.join(answers, same).drop("_key", "_micros")


def quota_audit(
    requests: DataFrame,
    key: str,
    micros: str,
    unique_id: str,
    tokens: Column,
    rpm: int = REQUESTS_PER_MINUTE,
    rpd: int = REQUESTS_PER_DAY,
    tpm: int = TOKENS_PER_MINUTE,
    **options,
) -> DataFrame:
    """Trailing minute and day usage of every request (itself included) and which quota it meets."""
    one = F.lit(1).cast("bigint")
    used = trailing_totals(
        requests,
        key,
        micros,
        unique_id,
        {"minute_requests": (MINUTE, one), "day_requests": (DAY, one), "minute_tokens": (MINUTE, tokens)},
        **options,
    )
    # The limits are tested against what was recorded before the request.
    return used.withColumn(
        "decision",
        F.when(F.col("day_requests") - 1 >= rpd, "refuse")
        .when(F.col("minute_requests") - 1 >= rpm, "wait_requests")
        .when(F.col("minute_tokens") > tpm, "wait_tokens")
        .otherwise("admit"),
    )


def usage_summary(ledger: DataFrame, model: Column, tokens: Column) -> DataFrame:
    """Requests and tokens per model and in total; a missing model counts as ``unknown``."""
    named = ledger.select(F.coalesce(model, F.lit("unknown")).alias("_model"), tokens.alias("_tokens"))
    return named.rollup("_model").agg(
        F.grouping("_model").alias("is_total"),
        F.count("*").alias("requests"),
        F.sum("_tokens").cast("bigint").alias("tokens"),
    ).select(
        F.when(F.col("is_total") == 1, F.lit("(all)")).otherwise(F.col("_model")).alias("model"), "requests", "tokens"
    )


def capable_models(models: DataFrame, name: str, actions: str, action: str = "generateContent", family: str = "gemini") -> DataFrame:
    """Models of a family that support an action, by name."""
    return models.where(F.array_contains(actions, F.lit(action)) & F.contains(F.col(name), F.lit(family))).orderBy(name)
