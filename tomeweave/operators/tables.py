"""Keyed tables: lookup, filtered scans, upsert, keep-last, delete, counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave import schemas

SUPPLIED = "__set"  # optional column of an update: names of the fields it sets
SEQUENCE = "__seq"  # optional column of an update: its place in the bulk


# ------------------------------------------------------------------ reads
def find_one(table: DataFrame, key: Mapping[str, object]) -> DataFrame:
    """At most one row, by equality on the key."""
    return find(table, key).limit(1)


def find(
    table: DataFrame,
    equal: Mapping[str, object] | None = None,
    order: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Rows equal on every given field; fields without a value and a zero limit mean no restriction."""
    wanted = [F.col(k) == F.lit(v) for k, v in (equal or {}).items() if v not in (None, "")]
    rows = table.where(reduce(lambda a, b: a & b, wanted)) if wanted else table
    if order:
        rows = rows.orderBy(*order)
    return rows.limit(limit) if limit else rows


def find_ordered(table: DataFrame, keys: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """The rows of a (position, key) list in its order; keys that are not found are dropped.

    A key named twice is returned twice, as repeated lookups would.
    """
    return keys.join(table, key).orderBy(position)


def containing(table: DataFrame, array: str, member: str) -> DataFrame:
    """Rows whose array holds one given value."""
    return table.where(F.array_contains(F.col(array), F.lit(member)))


def sample_by_hash(table: DataFrame, key: str, size: int, seed: str = "0") -> DataFrame:
    """A repeatable random sample of ``size`` rows: the smallest salted hashes of the key."""
    return table.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(size)


# ------------------------------------------------------------------ writes
def keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The row with the highest ``sequence`` of each key; ``sequence`` is unique per key.

    Only (keys, sequence) is aggregated, with a map-side partial, so a key that a
    third of all rows share costs one value per task. The rows are then picked by
    a join on a unique pair, which spreads evenly.
    """
    last = df.groupBy(*keys).agg(F.max(sequence).alias(sequence))
    left, right = df.alias("row"), last.alias("last")
    same = [F.col(f"row.{c}").eqNullSafe(F.col(f"last.{c}")) for c in (*keys, sequence)]
    return left.join(right, reduce(lambda a, b: a & b, same), "left_semi")


def collapse_updates(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One update per key: each field takes the last value a bulk supplied for it.

    Without ``__seq`` there is no last one, so a bulk that repeats a key fails.
    """
    fields = [c for c in updates.columns if c not in (*keys, SUPPLIED, SEQUENCE)]
    if SEQUENCE not in updates.columns:
        row = F.struct(*[F.col(c) for c in fields], _supplied(updates, fields).alias(SUPPLIED))
        single = updates.select(*keys, row.alias("_row")).groupBy(*keys).agg(F.count("*").alias("_n"), F.first("_row").alias("_row"))
        refused = F.raise_error(F.lit("the bulk repeats a key and has no __seq to order its rows")).cast("array<string>")
        return single.select(
            *keys, *[F.col("_row")[c].alias(c) for c in fields], F.when(F.col("_n") > 1, refused).otherwise(F.col("_row")[SUPPLIED]).alias(SUPPLIED)
        )
    marked = updates.withColumn(SUPPLIED, _supplied(updates, fields))
    picks = []
    for c in fields:
        when = F.when(F.array_contains(SUPPLIED, F.lit(c)), F.col(SEQUENCE))
        picks.append(F.max_by(F.struct(F.col(c)), when).alias(c))
    one = marked.groupBy(*keys).agg(*picks)
    return one.select(
        *keys,
        *[F.col(c)[c].alias(c) for c in fields],
        F.filter(
            F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields]), lambda s: s.isNotNull()
        ).alias(SUPPLIED),
    )


def _supplied(updates: DataFrame, fields: Sequence[str]) -> Column:
    return F.col(SUPPLIED) if SUPPLIED in updates.columns else F.array(*[F.lit(c) for c in fields])


def upsert(
    base: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    keep_created_at: bool = True,
) -> DataFrame:
    """``base`` with ``updates`` merged in by key.

    Fields an update does not supply keep their stored value, a supplied null
    overwrites it. ``created_at`` of a stored row is kept unless the switch says
    that a repeated ingest may overwrite it. Updates may repeat a key when they
    carry ``__seq``; the table itself has unique keys.
    """
    one = collapse_updates(updates, keys)
    fields = [c for c in one.columns if c not in (*keys, SUPPLIED)]
    incoming = one.withColumnsRenamed({c: f"_new_{c}" for c in fields}).withColumn("_hit", F.lit(True))
    merged = base.withColumn("_stored", F.lit(True)).join(incoming, list(keys), "full_outer")
    out = [F.col(k) for k in keys]
    for c in base.columns:
        if c in keys:
            continue
        if c not in fields:
            out.append(F.col(c))
            continue
        take = F.col("_hit").isNotNull() & F.array_contains(SUPPLIED, F.lit(c))
        if c == "created_at" and keep_created_at:
            take = take & F.col("_stored").isNull()
        out.append(F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    out.extend(F.col(f"_new_{c}").alias(c) for c in fields if c not in base.columns)
    return merged.select(*out)


def without(table: DataFrame, predicate: Column) -> DataFrame:
    """Rows that survive a delete; rows where the predicate is null are kept."""
    return table.where(~F.coalesce(predicate, F.lit(False)))


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their row counts."""
    return table.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), one row per table."""
    counted = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


class TableStore:
    """Named Parquet tables under one folder, replaced version by version.

    A rewrite goes to a new ``v=N`` folder and counts from the moment Spark's commit
    marker is there, so a lost job leaves the last good version in place and a
    running reader is never disturbed. Updates with new keys only are appended.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            path = status.getPath()
            if path.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                found.append(int(path.getName()[2:]))
        return sorted(found)

    def read(self, name: str) -> DataFrame:
        """The latest version; a table never written is empty."""
        versions = self._versions(name)
        schema = schemas.struct_of(name)
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v={versions[-1]}")

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(
            *[
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schemas.struct_of(name).fields
            ]
        )

    def replace(self, name: str, df: DataFrame) -> None:
        version = (self._versions(name) or [0])[-1] + 1
        self._shaped(name, df).write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows whose keys the table does not hold; its stored files are not touched."""
        version = (self._versions(name) or [1])[-1]
        self._shaped(name, df).write.mode("append").parquet(f"{self.root}/{name}/v={version}")

    def bulk_upsert(self, name: str, updates: DataFrame, keep_created_at: bool = True) -> int:
        """Merge updates by the table's key; returns how many keys were inserted or modified."""
        keys = schemas.KEYS[name]
        stamped = updates.withColumn("updated_at", F.current_timestamp())
        if SUPPLIED in stamped.columns:
            stamped = stamped.withColumn(SUPPLIED, F.array_append(SUPPLIED, F.lit("updated_at")))
        if "created_at" not in stamped.columns:
            stamped = stamped.withColumn("created_at", F.current_timestamp())
            if SUPPLIED in stamped.columns:
                stamped = stamped.withColumn(SUPPLIED, F.array_append(SUPPLIED, F.lit("created_at")))
        touched = stamped.select(*keys).distinct()
        n_touched = touched.count()
        if not n_touched:
            return 0
        stored = self.read(name)
        if stored.select(*keys).join(touched, keys, "left_semi").limit(1).count():
            self.replace(name, upsert(stored, stamped, keys, keep_created_at))
        else:
            # Only new keys, the usual case of an incremental run: nothing stored is rewritten.
            self.append(name, collapse_updates(stamped, keys))
        return n_touched

    def delete_where(self, name: str, predicate: Column) -> int:
        table = self.read(name)
        gone = table.where(predicate).count()
        if gone:
            self.replace(name, without(table, predicate))
        return gone

    def counts(self) -> DataFrame:
        names = ["graph_chunks", "rag_chunks", "extraction_results", "schemas", "embedding_cache", "qa_pairs"]
        return table_counts({n: self.read(n) for n in names})
