"""Whitening against plain numpy, and on awkward rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(vectors, count=16):
    """Eigenvectors of the covariance of the distinct quantised rows, by numpy."""
    x = np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    a = (n * fit - total) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    off = n * x - total
    return n, (off * off).sum(1), (off / n) @ v[:, :count] / np.sqrt(e[:count]), e[:count] / e.sum()


def check(spark, vectors, partitions=3):
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)]
    got = whitening.whiten_vectors(spark.createDataFrame(rows, SCHEMA).repartition(partitions)).toPandas()
    n, deviation, whitened, explained = brute(vectors)
    k = whitened.shape[1]
    assert len(got) == len(vectors) * k and set(got.n) == {n}
    got = got.sort_values(["vec_id", "component"])
    assert (got.deviation.to_numpy().reshape(-1, k) == deviation[:, None]).all()
    assert np.allclose(got.explained.to_numpy()[:k], explained, rtol=1e-9)
    z = got.whitened.to_numpy().reshape(-1, k)
    sign = np.sign((z * whitened).sum(0))
    assert np.allclose(z * sign, whitened, rtol=1e-6, atol=1e-7)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    return got


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, (600, 20)) * np.geomspace(3, 0.2, 20)
    check(spark, np.vstack([base, base[:100], base[:1]]))


def test_whitening_of_few_dimensions_and_ill_conditioned_rows(spark):
    rng = np.random.default_rng(2)
    check(spark, rng.normal(0, 1, (200, 3)))
    wide = rng.normal(0, 1, (400, 6)) * np.array([5000, 200, 30, 5, 1, 0.3])
    wide[:, 5] += wide[:, 0] + wide[:, 1]
    check(spark, wide)


def test_whitening_of_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = whitening.whiten_vectors(table)
    rows = table.filter("embedding IS NOT NULL").count()
    assert got.count() == rows * 16 and got.agg(F.max("identity_error")).first()[0] < 1e-9


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 0.5], 1), (1, [1.0, 2.0, 0.5], 1), (None, [0.0, 1.0, 0.5], None), (3, None, 1), (4, [], 1), (5, [1.0, None, 2.0], 1),
        (6, [nan, 0.0, 0.0], 1), (7, [inf, 0.0, 0.0], 1), (8, [4.0], 1), (9, [2.0, 2.0, 0.5], 2), (10, [3e38, 1.0], 2), (11, [-3e38, 1.0], 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("component", F.lit(7)).withColumn("n", F.lit(0))
    got = whitening.whiten_vectors(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == {1, None, 8, 9, 10, 11}
    assert len(by[1]) == 6 and len(by[None]) == 3 and len(by[8]) == 1 and len(by[10]) == 2
    assert {r.n for r in by[1]} == {3} and {r.n for r in by[8]} == {1}
    # the third dimension is constant, and a single vector varies nowhere
    assert by[9][2].whitened == 0 and by[8][0].whitened == 0 and by[8][0].explained == 0
    assert by[10][0].deviation is None and abs(by[10][0].whitened) == pytest.approx(1)
    assert max(r.identity_error for r in got) < 1e-10
    assert whitening.whiten_vectors(df.limit(0)).count() == 0


def test_right_solve_and_quantise():
    rng = np.random.default_rng(3)
    r = np.triu(rng.normal(0, 1, (9, 9))) + 4 * np.eye(9)
    rows = rng.normal(0, 1, (30, 9))
    assert np.allclose(whitening.right_solve(rows, r) @ r, rows)
    assert whitening.quantise(np.array([-0.001, 0.5, 0.0])).tolist() == [999_999, 1_000_032, 1_000_000]
