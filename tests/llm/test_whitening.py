import math
from fractions import Fraction

import numpy as np
import pytest

from tomeweave.llm import whitening


def plain(vectors, by_count=True):
    """(n, S, exact deviations, eigenvalues, covariance) by loops over whole numbers and fractions."""
    xs = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    fit = xs if by_count else [list(t) for t in {tuple(x) for x in xs}]
    n, d = len(fit), len(xs[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    cov = np.array([[float(sum((x[i] - Fraction(sums[i], n)) * (x[j] - Fraction(sums[j], n)) for x in fit) / n) for j in range(d)] for i in range(d)])
    return n, sums, [sum((n * x[k] - sums[k]) ** 2 for k in range(d)) for x in xs], cov, xs


def some_vectors(n, d, seed=5):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    rows = (rng.normal(size=(n, d)) @ mix + 3).astype(np.float32)
    return np.vstack([rows, np.repeat(rows[:1], n // 2, axis=0)]).tolist()


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_against_loops(spark, weights):
    vectors = some_vectors(60, 5)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<float>").repartition(5)
    rows = whitening.whiten(df, components=3, weights=weights).collect()
    n, sums, deviations, cov, xs = plain(vectors, weights == "counts")
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(rows) == 3 * len(vectors)
    want = (np.array(xs) - np.array(sums) / n) @ axes / np.sqrt(values)
    for c in range(3):
        part = sorted((r for r in rows if r.component == c + 1), key=lambda r: r.vec_id)
        got = np.array([r.whitened for r in part])
        assert [int(r.deviation) for r in part] == deviations and {r.n for r in part} == {n}
        assert min(np.abs(got - want[:, c]).max(), np.abs(got + want[:, c]).max()) < 1e-8
        assert part[0].explained == pytest.approx(values[c] / np.trace(cov), rel=1e-10)
    assert {r.identity_error for r in rows if r.identity_error < 1e-9}.__len__() == 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], 7), (1, [1.0, 2.0], 7), (None, [0.5, -1.0], 8), (2, None, 1), (3, [], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1),
        (6, [None, 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (8, [1e300, 0.0], 1), (9, [-0.25, 0.0], 2),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n int").selectExpr("*", "1 as component", "'k' as _key", "2 as _x")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (1, 1, 0, 9) for c in (1, 2))
    assert {r.n for r in got} == {4} and max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0
    flat = whitening.whiten(df.where("vec_id = 1")).collect()
    assert {(r.component, r.whitened, r.deviation, r.explained, r.identity_error) for r in flat} == {(1, None, 0, 0.0, None), (2, None, 0, 0.0, None)}
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(6)], "vec_id bigint, embedding array<double>")
    one = whitening.whiten(line).collect()
    assert {r.component for r in one if r.whitened is not None} == {1} and max(r.explained for r in one) == pytest.approx(1)


def test_numbers_beyond_64_bits():
    x = np.array([[1 << 61, 5], [-(1 << 61), 9]])
    d = whitening.centred(x, 8, (3, 4))
    assert d.tolist() == [[8 * (1 << 61) - 3, 36], [-8 * (1 << 61) - 3, 68]]
    assert whitening.squares(d) == [(8 * (1 << 61) - 3) ** 2 + 36**2, (8 * (1 << 61) + 3) ** 2 + 68**2]
    assert whitening.squares(np.array([[3, 4]])) == [25]


def test_contract_columns(spark):
    from tomeweave.llm import queries

    found = queries.op12(spark, "/root/testdata/sf0.001")
    kinds = dict(found.dtypes)
    assert kinds["deviation"] == "bigint" and kinds["component"] == "int" and kinds["n"] == "bigint"
    assert found.where("deviation is null or abs(identity_error) > 1e-6").count() == 0
