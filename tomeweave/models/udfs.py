"""Model calls as columns. Batches of texts go in, rows with a status come out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.functions.text import mask_key
from tomeweave.models.boundary import Embedder, Generator, Retry

EMBEDDED = T.StructType(
    [T.StructField("embedding", T.ArrayType(T.FloatType(), False)), T.StructField("error", T.StringType())]
)
GENERATED = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


REQUEST_TEXTS = 20  # texts in one embedding request


def embed_column(text: Column, model: Embedder, retry: Retry | None = None, request: int = REQUEST_TEXTS) -> Column:
    """struct(embedding, error): a text whose call fails for good carries the error and no vector.

    Texts go out ``request`` at a time; where a request fails, only its texts are
    tried one by one. The call counts as non-deterministic: two calls may differ,
    so Catalyst must not compute the column a second time to filter on it.
    """

    @F.pandas_udf(EMBEDDED)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        attempt = retry or (lambda f: f())
        for texts in batches:
            vectors, errors = [], []
            for first in range(0, len(texts), request):
                part = texts.iloc[first : first + request].tolist()
                try:
                    got, failed = list(attempt(lambda part=part: model.embed(part))), [None] * len(part)
                except Exception:
                    got, failed = [], []
                    for text in part:
                        try:
                            got.append(attempt(lambda text=text: model.embed([text]))[0])
                            failed.append(None)
                        except Exception as error:
                            got.append(None)
                            failed.append(str(error))
                vectors += got
                errors += failed
            yield pd.DataFrame({"embedding": vectors, "error": errors})

    return call.asNondeterministic()(text)


def generate_column(prompt: Column, model: Generator, retry: Retry | None = None) -> Column:
    """struct(content, usage, finish_reason, model, error) per prompt."""

    @F.pandas_udf(GENERATED)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        attempt = retry or (lambda f: f())
        for prompts in batches:
            rows = []
            for text in prompts:
                try:
                    reply = attempt(lambda text=text: model.generate([text]))[0]
                    rows.append({"model": model.name, "error": None, **reply})
                except Exception as error:
                    rows.append({"model": model.name, "error": str(error)})
            # Object columns keep the integers of good replies next to the nulls of failed ones.
            yield pd.DataFrame({f.name: [r.get(f.name) for r in rows] for f in GENERATED.fields}, dtype=object)

    return call.asNondeterministic()(prompt)


def structured(reply: DataFrame, content: str, schema: str) -> DataFrame:
    """Parse a reply against a schema: ``parsed`` is null where the content does not fit."""
    return reply.withColumn("parsed", F.from_json(F.col(content), schema, {"mode": "PERMISSIVE"}))


def usage_rows(replies: DataFrame, reply: str, provider: str, api_key: Column) -> DataFrame:
    """Ledger rows of generated replies."""
    r = F.col(reply)
    none = F.lit(None)
    return replies.where(r["error"].isNull()).select(
        r["input_tokens"].alias("input_tokens"),
        r["output_tokens"].alias("output_tokens"),
        (r["input_tokens"] + r["output_tokens"]).alias("total_tokens"),
        F.lit(0).cast("bigint").alias("cached_tokens"),
        F.lit(0).cast("bigint").alias("reasoning_tokens"),
        *[none.cast("double").alias(c) for c in ("input_cost_usd", "output_cost_usd", "total_cost_usd")],
        F.lit(provider).alias("provider"),
        r["model"].alias("model"),
        (F.unix_micros(F.current_timestamp()) / 1e6).alias("timestamp"),
        mask_key(api_key).alias("api_key_last4"),
    )

