"""Shared pieces of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Catalogue:
    """Queries by name, with the SQL each has to agree with."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(run: Query) -> Query:
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return run

        return register


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def event_micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def event_tokens() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")
