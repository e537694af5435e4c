"""Metrics and curves against direct computation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import curves, metrics, ordering


def _frame(spark, y, scores, model="m"):
    rows = [(model, int(t), int(s > 0.5), [1 - float(s), float(s)]) for t, s in zip(y, scores)]
    return spark.createDataFrame(rows, "model STRING, y_true INT, y_pred INT, proba ARRAY<DOUBLE>")


def _auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def _ap(y, s):
    total, ap, last = y.sum(), 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, n = y[s >= t].sum(), (s >= t).sum()
        ap += (tp / total - last) * tp / n
        last = tp / total
    return ap


@pytest.mark.parametrize("kind", ["ties", "perfect", "inverted", "random"])
def test_ranking_metrics(spark, kind):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 60)
    s = {"ties": rng.integers(0, 4, 60) / 4, "perfect": y * 0.9, "inverted": 1 - y * 0.9, "random": rng.random(60)}[kind]
    df = _frame(spark, y, s)
    row = metrics.binary_ranking(df, ["model"]).first()
    assert row.roc_auc == pytest.approx(_auc(y, s))
    assert row.average_precision == pytest.approx(_ap(y, s))


def test_one_class_has_no_auc(spark):
    row = metrics.binary_ranking(_frame(spark, [1, 1], [0.2, 0.3]), ["model"]).first()
    assert row.roc_auc is None and row.average_precision == 1.0


def test_zero_denominators(spark):
    row = metrics.classification_metrics(_frame(spark, [1, 0], [0.1, 0.2]), ["model"]).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.0, 0.0, 0.0)


def _interp_frame(spark, xs, ys):
    rows = [("m", i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))]
    return spark.createDataFrame(rows, "model STRING, ord BIGINT, x DOUBLE, y DOUBLE")


@pytest.mark.parametrize("seed", range(3))
def test_grid_equals_linear_interpolation(spark, seed):
    rng = np.random.default_rng(seed)
    n = 11
    xs = np.sort(np.concatenate([[0.0, 1.0], rng.integers(0, 21, 12) / 20, rng.random(4)]))
    ys = np.sort(rng.random(len(xs)))
    got = curves.curve_on_grid(_interp_frame(spark, xs, ys), ["model"], "x", "y", n=n).orderBy("g").collect()
    grid = np.linspace(0, 1, n)
    # of equal x the last point holds
    assert [r.y for r in got] == pytest.approx(list(np.interp(grid, xs, ys)))


def test_roc_corner_points(spark):
    # one long diagonal run of equal steps keeps its ends only
    rows = [("m", s, 1, 1) for s in (0.9, 0.8, 0.7, 0.6)] + [("m", 0.5, 0, 3)]
    scores = spark.createDataFrame(rows, "model STRING, score DOUBLE, pos BIGINT, neg BIGINT")
    points = curves._roc_corners(scores, ["model"]).orderBy(F.col("threshold").desc()).collect()
    assert [r.threshold for r in points] == [float("inf"), 0.9, 0.6, 0.5]


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_running_totals_of_a_hot_group(spark, partitions):
    """A third and more of the rows in one group, spread over all range partitions."""
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("other").alias("g"), "id")
        out = ordering.running_totals(df, ["g"], ["id"], {"n": F.lit(1).cast("bigint"), "s": F.col("id")})
        rows = out.toPandas().sort_values(["g", "id"])
        for _, part in rows.groupby("g"):
            assert list(part.n) == list(range(1, len(part) + 1))
            assert list(part.s) == list(part.id.cumsum())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
