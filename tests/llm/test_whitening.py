import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import whitening as wh
from scoreloom.llm.queries import PLANS


def exact(vectors):
    """Integers, count, sums and deviations in whole numbers; eigenvectors of the covariance of centred rows."""
    width = max(map(len, vectors), default=0)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    y = np.array([[float(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, deviations, y, values[::-1], vectors[:, ::-1]


def check(rows, vectors, wanted=32, planes=False):
    """``rows``: (deviation, whitened, explained, identity_error) in the order of the vectors."""
    n, deviations, y, values, axes = exact(vectors)
    k = min(wanted, int((values > 1e-12 * values[0]).sum()))
    got = np.array([r[1] for r in rows])
    assert [int(r[0]) for r in rows] == deviations
    assert got.shape == (n, k)
    assert np.allclose([r[2] for r in rows], values[:k] / values.sum(), rtol=1e-4, atol=0)
    assert max(r[3] for r in rows) <= 1e-4
    assert np.abs(got.T @ got / n - np.eye(k)).max() <= 1e-6
    if not planes:
        want = y @ axes[:, :k] / np.sqrt(values[:k])
        sign = np.sign((want * got).sum(axis=0))
        assert np.allclose(got * sign, want, atol=1e-6 * np.abs(want).max())


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("x", "ID", "block", "n", "at", "v"):
        df = df.withColumn(name, F.lit("7"))
    return [(r["id"], r["n"], (r["deviation"], r["whitened"], r["explained"], r["identity_error"]))
            for r in wh.whiten(df, **options).orderBy("id").collect()]


def test_query_on_the_test_tables(spark, sf):
    vectors = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()}
    out, rows = PLANS["op11_embedding_whitening"](spark, sf), {}
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                "whitened": "double", "explained": "double", "identity_error": "double"}
    for r in out.orderBy("vec_id", "component").collect():
        rows.setdefault(r["vec_id"], []).append(r)
    assert all([r["component"] for r in rs] == list(range(1, 33)) for rs in rows.values())
    assert {r["n"] for rs in rows.values() for r in rs} == {len(vectors)}
    check([(rs[0]["deviation"], [r["whitened"] for r in rs], [r["explained"] for r in rs], rs[0]["identity_error"])
           for _, rs in sorted(rows.items())], [vectors[i] for i in sorted(vectors)])


@pytest.mark.parametrize("tolerance", [None, 1e-9])
def test_falling_spectrum_and_small_blocks(spark, tolerance):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 10)) @ np.diag(0.5 ** np.arange(10) * 40) @ np.linalg.qr(rng.normal(size=(10, 10)))[0]
    got = run(spark, list(enumerate(vectors.tolist())), wanted=4, tolerance=tolerance, block_bytes=800)
    assert {r[1] for r in got} == {300}
    check([r[2] for r in got], vectors.tolist(), wanted=4)


def test_directions_without_variance_are_left_out(spark):
    """Rank two of five dimensions; one dimension constant, one a copy."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(-50, 50, size=(2, 80)) / 64.0
    vectors = np.column_stack([a, b, a, np.full(80, 3.0), a + b]).tolist()
    got = run(spark, list(enumerate(vectors)))
    check([r[2] for r in got], vectors)
    assert len(got[0][2][1]) == 2


def test_equal_eigenvalues(spark):
    vectors = [[s * 4.0 * (i == j) for j in range(3)] for i in range(3) for s in (1, -1)]
    check([r[2] for r in run(spark, list(enumerate(vectors)))], vectors, planes=True)


def test_nulls_copies_lengths_and_nothing(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [1.0, 2.0, 0.5], [0.25, -1.0], [], [3.0, 1.0, -2.0]]
    bad = [None, [nan, 1.0], [inf], [-inf, 0.0, 1.0], [None, 1.0]]
    got = run(spark, list(enumerate(good + bad)))
    assert [r[0] for r in got] == [0, 1, 2, 3, 4]
    check([r[2] for r in got], good)
    assert run(spark, []) == run(spark, [(1, None)]) == run(spark, [(1, [2.0, 3.0])] * 3) == run(spark, [(1, [])]) == []
    assert len(run(spark, [(None, [1.0]), (None, [2.0])])) == 2


def test_deviations_beyond_a_long():
    centre = wh.Centre(10 ** 9, (10 ** 15 + 10 ** 10, 10 ** 15))
    x = np.array([[1_000_000 + 10 ** 6, 1_000_000]])
    assert centre.deviations(x) == [(10 ** 9 * 2_000_000 - 10 ** 15 - 10 ** 10) ** 2]
