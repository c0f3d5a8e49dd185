"""Structured Streaming forms of the ledger, the request limiter and incremental embedding."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tomeweave.constants import REQUESTS_PER_DAY, REQUESTS_PER_MINUTE, TOKENS_PER_MINUTE
from tomeweave.models.boundary import Embedder, Retry
from tomeweave.operators.incremental import embed_pending
from tomeweave.session import scratch_path

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000


def file_stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet", files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return (
        spark.readStream.schema(like.schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def run_to_table(stream: DataFrame, label: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain an append-mode stream into a Parquet table and read it.

    With the caller's ``out`` and ``checkpoint`` a later call appends what has arrived
    since; otherwise both are scratch places.
    """
    spark = stream.sparkSession
    if (out is None) != (checkpoint is None):
        raise ValueError("a resumable table needs both its output and its checkpoint")
    out, checkpoint = out or scratch_path(spark, label), checkpoint or scratch_path(spark, f"{label}-state")
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def accumulate_usage(stream: DataFrame, model: Column, tokens: Column, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Usage per model and in total over all that has ever arrived.

    Each micro-batch is reduced to one row per model and stored below ``out`` under
    its batch id, so a repeated batch replaces itself; the summary adds those few rows.
    ``out`` and ``checkpoint`` belong to the caller: a later call with the same two
    goes on where the last one stopped, or broke off. Without them a scratch place is used once.
    """
    spark = stream.sparkSession
    if (out is None) != (checkpoint is None):
        raise ValueError("a resumable ledger needs both its output and its checkpoint")
    target, state = out or scratch_path(spark, "usage"), checkpoint or scratch_path(spark, "usage-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        (
            batch.groupBy(F.coalesce(model, F.lit("unknown")).alias("model"))
            .agg(F.count("*").alias("requests"), F.sum(tokens).cast("bigint").alias("tokens"))
            .write.mode("overwrite")
            .parquet(f"{target}/batch={batch_id}")
        )

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return usage_so_far(spark, target)


def usage_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The ledger below ``out``: usage per model, and in total."""
    parts = spark.read.schema("model STRING, requests BIGINT, tokens BIGINT, batch BIGINT").parquet(out)
    total = parts.rollup("model").agg(
        F.grouping("model").alias("_all"), F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens")
    )
    return total.select(
        F.when(F.col("_all") == 1, F.lit("(all)")).otherwise(F.col("model")).alias("model"), "requests", "tokens"
    )


@dataclass(frozen=True)
class Quota:
    rpm: int = REQUESTS_PER_MINUTE
    rpd: int = REQUESTS_PER_DAY
    tpm: int = TOKENS_PER_MINUTE


def admit(times: np.ndarray, tokens: np.ndarray, log: np.ndarray, quota: Quota):
    """Decisions for requests in time order, given the (time, tokens) log of recorded ones.

    A refused request is not recorded; one that has to wait is. The log never
    holds more than a day, and never more than the daily quota.
    """
    whats, waits = [], []
    day = deque(tuple(x) for x in log.tolist())
    minute = deque()
    minute_tokens = 0
    for entry in day:
        minute.append(entry)
        minute_tokens += entry[1]
    for now, cost in zip(times.tolist(), tokens.tolist()):
        while day and day[0][0] <= now - DAY_US:
            day.popleft()
        while minute and minute[0][0] <= now - MINUTE_US:
            minute_tokens -= minute.popleft()[1]
        until_free = max(60 - (now - minute[0][0]) / 1e6, 1.0) if minute else 1.0
        what, wait = "admit", 0.0
        if len(minute) >= quota.rpm:
            what, wait = "wait_requests", until_free
        if len(day) >= quota.rpd:
            what = "refuse"
        elif minute_tokens + cost > quota.tpm:
            what = "wait_tokens" if what == "admit" else what
            wait += until_free
        if what != "refuse":
            day.append((now, cost))
            minute.append((now, cost))
            minute_tokens += cost
        whats.append(what)
        waits.append(wait)
    return whats, waits, np.array(day, dtype=np.int64).reshape(-1, 2)


def limit_requests(stream: DataFrame, key: str, unique_id: str, micros: str, tokens: str, quota: Quota = Quota()) -> DataFrame:
    """Admit, delay or refuse each request of a stream.

    Decisions of one key depend on its earlier ones, so a key is one unit of state:
    at most ``quota.rpd`` pairs of integers. Micro-batches bound what one call
    sees; only three integers per request are held while it is put in order.
    """
    narrow = stream.select(key, F.col(unique_id), F.col(micros), F.col(tokens).cast("bigint").alias(tokens))
    id_type = narrow.schema[unique_id].dataType.simpleString()
    key_type = narrow.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], dtype=np.int64).reshape(-1, 2) if state.exists else np.empty((0, 2), np.int64)
        rows = pd.concat([b[[unique_id, micros, tokens]] for b in batches]).sort_values([micros, unique_id])
        whats, waits, held = admit(rows[micros].to_numpy(), rows[tokens].to_numpy(), held, quota)
        state.update((held.tobytes(),))
        yield pd.DataFrame(
            {key: [group[0]] * len(rows), unique_id: rows[unique_id].to_numpy(), "decision": whats, "wait_seconds": waits}
        )

    return narrow.groupBy(key).applyInPandasWithState(
        step,
        f"{key} {key_type}, {unique_id} {id_type}, decision STRING, wait_seconds DOUBLE",
        "log BINARY",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def embed_arrivals(stream: DataFrame, path: str, checkpoint: str, model: Embedder, retry: Retry | None = None):
    """Embed chunk files as they arrive; the anti-join makes a repeated batch harmless."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: embed_pending(batch, path, model, retry))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
