"""Embedding whitening by weighted multiplicity covariance.

Vectors become whole numbers, ``x = floor(scale * c) + offset``. Identical
x-vectors are grouped first, with the number of their rows as weight; the
covariance is a weighted GEMM over the distinct vectors, centred by the exact
mean before anything is multiplied. Every distinct vector is projected once and
the result is joined back to the rows by a strong digest of x.

Only figures whose size depends on the dimension alone reach the driver: a sum
per dimension and the covariance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.session import cut_lineage, ship_package

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
MAX_DIMENSION = 8_192  # a covariance of 0.5 GB
SLICE_BYTES = 8 << 20  # of one block of vectors as doubles
SAFE = 1 << 62  # whole numbers below this stay in 64 bits
LIMIT = float(1 << 52)  # of a scaled entry
ID, X, KEY, COPIES, WHITE, DEVIATION = "_id", "_x", "_key", "_copies", "_white", "_deviation"
RESULT = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: fit rows, exact sums, eigenvalues in falling order and unit eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    components: int

    @property
    def live(self) -> int:
        """Leading components whose variance is more than rounding."""
        top = self.values[: self.components]
        return int(np.sum(top > max(self.values[0], 0) * len(self.sums) * np.finfo(float).eps)) if len(top) else 0


def whole_numbers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """x of a vector; null for a vector that is null or empty or has null, non-finite or (scaled) 2**52 and larger entries."""
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LIMIT, F.lit(False)))
    each = F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + offset)
    return F.when(usable & (F.size(vector) > 0), each)


def _key(x: Column) -> Column:
    return F.unhex(F.sha2(x.cast("string"), 256))


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _slices(rows: int, width: int) -> Iterator[slice]:
    step = max(1, SLICE_BYTES // (8 * max(1, width)))
    for first in range(0, rows, step):
        yield slice(first, min(rows, first + step))


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S in whole numbers; 64 bits where they are wide enough, else Python integers."""
    most = max(int(np.abs(x).max(initial=0)), 1) * n + max((abs(s) for s in sums), default=0)
    if most < SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(d: np.ndarray) -> list[int]:
    """Exact sum of squares of every row of whole numbers."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < SAFE:
        return (d * d).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in d.astype(object).tolist()]


def _partition_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] = []
    for batch in batches:
        x, w = _matrix(batch.column(0)), batch.column(1).to_numpy().astype(np.int64)
        if not len(w):
            continue
        if int(np.abs(x).max(initial=0)) * int(w.sum()) < SAFE:
            part = (w @ x).tolist()
        else:
            part = (w.astype(object) @ x.astype(object)).tolist()
        total = [a + b for a, b in zip(total, part, strict=True)] if total else part
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array([str(s) for s in total], pa.string())], ["dim", "part"]
        )


def _products(df: DataFrame, width: int, rows_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum over all rows of weight * z z^T, where ``rows_of`` gives (z, weight) of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for part in _slices(batch.num_rows, width):
                z, w = rows_of(batch.slice(part.start, part.stop - part.start))
                total += (z * w[:, None]).T @ z
        if total.any():
            values = pa.array(list(total), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), values], ["i", "row"])

    rows = df.mapInArrow(run, "i int, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).where("j >= i")
    out = np.zeros((width, width))
    for i, j, v in cells.groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def _fit(distinct: DataFrame, components: int, by_count: bool) -> Whitening | None:
    weight = F.col(COPIES) if by_count else F.lit(1).cast("bigint")
    list_ = distinct.select(X, weight.alias(COPIES))
    n = list_.agg(F.sum(COPIES)).first()[0]
    if not n:
        return None
    parts = list_.mapInArrow(_partition_sums, "dim int, part string")
    found = parts.groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    sums = tuple(int(r["s"]) for r in found)

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        z = centred(_matrix(batch.column(0)), n, sums).astype(np.float64) / n
        return z, batch.column(1).to_numpy().astype(np.float64)

    covariance = _products(list_, len(sums), rows_of) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values, kind="stable")[::-1]
    values, vectors = values[order], vectors[:, order]
    # One sign for all rows and runs: the largest entry of a component is positive.
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)
    return Whitening(int(n), sums, values, vectors, float(np.trace(covariance)), min(components, len(sums)))


def _whitener(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n, sums, k, live = model.n, model.sums, model.components, model.live
    axes = model.vectors[:, :live] / np.sqrt(model.values[:live])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _slices(whole.num_rows, len(sums)):
                batch = whole.slice(part.start, part.stop - part.start)
                d = centred(_matrix(batch.column(0)), n, sums)
                z = (d.astype(np.float64) / n) @ axes
                white = [[*row, *[None] * (k - live)] for row in z.tolist()]
                exact = [Decimal(s) if s < 10**38 else None for s in squares(d)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), batch.column(2), pa.array(exact, pa.decimal128(38, 0)), pa.array(white, pa.list_(pa.float64()))],
                    [KEY, COPIES, DEVIATION, WHITE],
                )

    return run


def _identity_error(white: DataFrame, model: Whitening, by_count: bool) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on what was written."""
    live, n = model.live, model.n
    if not live:
        return None
    rows = white.select(WHITE, (F.col(COPIES) if by_count else F.lit(1)).cast("bigint").alias(COPIES))
    mean = np.array(rows.agg(*[F.sum(F.get(WHITE, F.lit(c)) * F.col(COPIES)) for c in range(live)]).first(), float) / n

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        z = _matrix(batch.column(0), np.float64)[:, :live] - mean
        return z, batch.column(1).to_numpy().astype(np.float64)

    return float(np.abs(_products(rows, live, rows_of) / n - np.eye(live)).max())


def whiten(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    weights: str = "counts",
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """A row for each usable row of ``df`` and each leading component: the id column and ``RESULT``.

    The fit list holds every usable vector as often as it occurs (``weights="counts"``)
    or once (``weights="one"``); ``n`` is its length. ``deviation`` is the exact sum
    of squares of n * x - S (null beyond 38 digits), ``whitened`` the projection of
    x - S/n over the root of the component's variance, ``explained`` that variance's
    share of all.

    Left out: vectors that are null, empty or hold null, non-finite or immense
    entries, and, since a covariance needs one dimension, vectors of another length
    than most have (of equally common lengths the greater counts). Null ids and
    repeated rows stay, each with its own result. Vectors of fewer dimensions than
    ``components`` have that many components; a component without variance has a
    null ``whitened`` (with none at all the error is null too). An empty table gives
    no rows. Other columns of ``df`` are not looked at.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    spark, by_count = df.sparkSession, weights == "counts"
    ship_package(spark)
    rows = df.select(F.col(id_col).alias(ID), whole_numbers(F.col(vector), scale, offset).alias(X)).where(F.col(X).isNotNull())
    each = rows.groupBy(X).agg(F.count(F.lit(1)).alias(COPIES))
    distinct = cut_lineage(each.withColumn(KEY, _key(F.col(X))), "vectors")
    longest = distinct.groupBy(F.size(X).alias("d")).agg(F.sum(COPIES).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    empty = spark.createDataFrame([], f"{id_col} {df.schema[id_col].dataType.simpleString()}, {RESULT}")
    if longest is None:
        return empty
    if longest["d"] > MAX_DIMENSION:
        raise ValueError(f"vectors of {longest['d']} dimensions; at most {MAX_DIMENSION}")
    distinct = distinct.where(F.size(X) == longest["d"])
    model = _fit(distinct, components, by_count)
    white = cut_lineage(
        distinct.select(X, KEY, COPIES).mapInArrow(
            _whitener(model), f"{KEY} binary, {COPIES} bigint, {DEVIATION} decimal(38,0), {WHITE} array<double>"
        ),
        "whitened",
    )
    error = _identity_error(white, model, by_count)
    shares = F.array(*[F.lit(float(max(v, 0.0) / model.trace) if model.trace else 0.0) for v in model.values[: model.components]])
    # A very common vector is one key here; adaptive execution splits the rows' side, the other side has one row a key.
    joined = rows.select(ID, _key(F.col(X)).alias(KEY)).join(white.select(KEY, DEVIATION, WHITE), KEY)
    return joined.select(ID, DEVIATION, F.posexplode(WHITE).alias("_at", "whitened")).select(
        F.col(ID).alias(id_col), (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"),
        F.col(DEVIATION).alias("deviation"), "whitened", F.get(shares, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
