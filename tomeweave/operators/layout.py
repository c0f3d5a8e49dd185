"""Keyed tables laid out so that a lookup, a merge or a join touches only what it must.

``KeyedTable`` keeps its rows in folders by a hash of the key. A merge finds the
folders of the keys it brings, rewrites those and leaves every other file as it is.
``sorted_buckets`` stores rows bucketed and sorted, so that a join on the key
moves the other side only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.operators.tables import SEQUENCE, SUPPLIED, collapse_updates, upsert
from tomeweave.session import cut_lineage

BUCKET = "_bucket"
BUCKETS = 256


@dataclass(frozen=True)
class Changed:
    """What a write did."""

    inserted: int = 0
    modified: int = 0
    deleted: int = 0
    buckets: tuple[int, ...] = ()


class KeyedTable:
    """A Parquet table of unique keys below ``path``, in ``buckets`` folders by the key's hash.

    Choose ``buckets`` so that one holds what a few tasks can rewrite (at 100 TB
    and 4,096 buckets 25 GB); it is fixed for the table's life. Folders are replaced whole
    when a job commits. A job that is lost before leaves them as they were, and one lost while
    committing is repeated: merges of the same updates give the same table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])

    # ---------------------------------------------------------------- reads
    def _bucket(self, values: Sequence[Column]) -> Column:
        kinds = [self.schema[k].dataType for k in self.keys]
        return F.pmod(F.xxhash64(*[v.cast(t) for v, t in zip(values, kinds, strict=True)]), F.lit(self.buckets)).cast("int")

    def _folder(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _rows(self) -> DataFrame:
        folder, fs = self._folder()
        if not fs.exists(folder):
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop(BUCKET)

    def find(self, key: Mapping[str, object]) -> DataFrame:
        """The row of one key; only its bucket is read."""
        at = self._bucket([F.lit(key[k]) for k in self.keys])
        same = [F.col(k) == F.lit(key[k]) for k in self.keys]
        return self._rows().where(reduce(lambda a, b: a & b, [F.col(BUCKET) == at, *same])).drop(BUCKET)

    def find_all(self, keys: DataFrame) -> DataFrame:
        """The rows of a table of keys; buckets without one are not read where their number is known to be small."""
        asked = keys.select(*self.keys).distinct().withColumn(BUCKET, self._bucket([F.col(k) for k in self.keys]))
        return self._rows().join(asked, [BUCKET, *self.keys], "left_semi").drop(BUCKET)

    # --------------------------------------------------------------- writes
    def _replace(self, rows: DataFrame, touched: Sequence[int]) -> None:
        """Put ``rows``, all that is left of the touched buckets, in place of their folders."""
        rows.repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(BUCKET).parquet(self.path)
        filled = {r[0] for r in rows.select(BUCKET).distinct().collect()}
        for number in touched:
            if number not in filled:
                folder, fs = self._folder(f"{BUCKET}={number}")
                if fs.exists(folder):
                    fs.delete(folder, True)

    def merge(self, updates: DataFrame, keep_created_at: bool = True) -> Changed:
        """Insert or modify by key, as ``tables.upsert`` does, in the buckets of the updates' keys alone.

        A key that the bulk repeats needs ``__seq``. Modified counts every stored row that
        an update names, inserted every new one.
        """
        one = collapse_updates(updates, self.keys).withColumn(BUCKET, self._bucket([F.col(k) for k in self.keys]))
        one = cut_lineage(one, "updates")
        # At most one number for each bucket.
        touched = sorted(r[0] for r in one.select(BUCKET).distinct().collect())
        if not touched:
            return Changed()
        stored = self._rows().where(F.col(BUCKET).isin(touched))
        known = one.select(*self.keys, BUCKET).join(stored.select(*self.keys, BUCKET), [*self.keys, BUCKET], "left_semi")
        modified = known.count()
        merged = upsert(stored, one, [*self.keys, BUCKET], keep_created_at)
        shaped = [(F.col(f.name) if f.name in merged.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._stored.fields]
        # Written aside first: what is read below no longer depends on the folders it replaces.
        self._replace(cut_lineage(merged.select(*shaped), "merged"), touched)
        return Changed(inserted=one.count() - modified, modified=modified, buckets=tuple(touched))

    def delete(self, predicate: Column) -> Changed:
        """Delete the rows for which the predicate is true; only buckets that hold one are rewritten."""
        rows = self._rows()
        hit = {r[0]: r[1] for r in rows.where(predicate).groupBy(BUCKET).count().collect()}
        if not hit:
            return Changed()
        rest = rows.where(F.col(BUCKET).isin(sorted(hit))).where(~F.coalesce(predicate, F.lit(False)))
        self._replace(cut_lineage(rest, "survivors"), sorted(hit))
        return Changed(deleted=sum(hit.values()), buckets=tuple(sorted(hit)))

    def files(self) -> dict[int, frozenset[str]]:
        """Names of the stored files by bucket."""
        listed = self._rows().select(BUCKET, F.input_file_name().alias("f")).groupBy(BUCKET).agg(F.collect_set("f"))
        return {r[0]: frozenset(r[1]) for r in listed.collect()}


def sorted_buckets(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Store ``df`` as table ``name`` at ``path``, bucketed and sorted by ``keys``, and open it.

    A join on the keys reads every bucket in one task and shuffles the other side into as many partitions.
    """
    df.repartition(buckets, *keys).write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def open_buckets(spark: SparkSession, name: str, path: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Open what ``sorted_buckets`` stored, in a session that does not know the table."""
    listed = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({listed}) SORTED BY ({listed}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def join_stored(asked: DataFrame, stored: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``asked`` joined to a bucketed table on its keys; the stored side is neither shuffled nor broadcast."""
    return asked.join(stored.hint("merge"), list(keys), how)


__all__ = ["BUCKET", "SEQUENCE", "SUPPLIED", "Changed", "KeyedTable", "join_stored", "open_buckets", "sorted_buckets"]
