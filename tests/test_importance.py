"""Functional analysis of variance against integration over a grid."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.learning import search, spaces
from labelweave.learning.importance import Domain, leaf_boxes, marginal_shares

TREE = [
    {"id": 0, "feature": 0, "threshold": 0.3, "left": 1, "right": 2, "value": 0.0},
    {"id": 1, "feature": -1, "threshold": None, "left": -1, "right": -1, "value": 1.0},
    {"id": 2, "feature": 1, "threshold": 2.0, "left": 3, "right": 4, "value": 0.0},
    {"id": 3, "feature": 0, "threshold": 0.7, "left": 5, "right": 6, "value": 0.0},
    {"id": 4, "feature": -1, "threshold": None, "left": -1, "right": -1, "value": 5.0},
    {"id": 5, "feature": -1, "threshold": None, "left": -1, "right": -1, "value": -2.0},
    {"id": 6, "feature": -1, "threshold": None, "left": -1, "right": -1, "value": 0.5},
]


def value_at(point):
    number = 0
    while TREE[number]["feature"] >= 0:
        node = TREE[number]
        number = node["left"] if point[node["feature"]] <= node["threshold"] else node["right"]
    return TREE[number]["value"]


def test_shares_equal_integration_over_a_grid():
    domains = [Domain((), 0.0, 1.0), Domain((1.0, 2.0, 3.0, 4.0))]
    first = (np.arange(1000) + 0.5) / 1000
    grid = np.array([[value_at((a, b)) for b in domains[1].values] for a in first])
    whole = grid.var()
    want = [grid.mean(1).var() / whole, grid.mean(0).var() / whole]
    got = marginal_shares(*leaf_boxes(TREE, 2), domains)
    assert got == pytest.approx(want, abs=1e-9) and got.sum() < 1


def test_a_constant_tree_explains_nothing():
    leaf = [{"id": 0, "feature": -1, "threshold": None, "left": -1, "right": -1, "value": 3.0}]
    assert marginal_shares(*leaf_boxes(leaf, 2), [Domain(), Domain((1.0, 2.0))]).tolist() == [0.0, 0.0]


def test_measures():
    d = Domain((1.0, 3.0, 5.0, 7.0))
    assert d.measure(np.array([-np.inf, 3.0, 5.5]), np.array([3.0, 7.0, 6.0])).tolist() == [0.5, 0.5, 0.0]
    assert Domain((), 2.0, 6.0).measure(np.array([-np.inf, 3.0]), np.array([3.0, np.inf])).tolist() == [0.25, 0.75]


def test_the_parameter_behind_the_score_is_found(spark):
    trials = spaces.trial_table(spark, "s", 400, "multi_layer_perceptron")
    alpha = F.ln(F.col("params")["alpha"].cast("double"))
    noise = F.col("params")["max_iter"].cast("double") / 1e5
    for column, name in ((alpha, "alpha"), (F.when(F.col("params")["activation"] == "relu", 1.0).otherwise(0.0), "activation")):
        got = {r.param: r.value for r in search.param_importance(trials.withColumn("score", column + noise), "multi_layer_perceptron", trees=10).collect()}
        assert max(got, key=got.get) == name and got[name] > 0.8 and 0 < sum(got.values()) <= 1.0001
        assert set(got) == {p.name for p in spaces.param_space("multi_layer_perceptron") if p.kind != "fixed"}


def test_trials_without_scores_are_left_out(spark):
    trials = spaces.trial_table(spark, "s", 60, "decision_tree").withColumn("score", F.when(F.col("trial") % 2 == 0, F.lit(None)).otherwise(F.col("params")["max_depth"].cast("double")))
    got = {r.param: r.value for r in search.param_importance(trials, "decision_tree", trees=5).collect()}
    assert max(got, key=got.get) == "max_depth"
