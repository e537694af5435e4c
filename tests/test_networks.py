"""Perceptrons: gradients by differences, both ways to fit, every parameter."""

from __future__ import annotations

import math

import numpy as np
import pytest

from labelweave.learning import models
from labelweave.learning.jobs import fit_predict
from labelweave.learning.networks import NetSpec, first_weights, fit_asking_here, loss_sums, margins, optimise
from labelweave.learning.trees import link
from tests.test_trees import ROWS, frame, table


@pytest.mark.parametrize("activation", ["tanh", "relu", "logistic"])
@pytest.mark.parametrize("classes", [2, 3])
def test_gradients_are_differences_of_the_loss(activation, classes):
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 1, (12, 4)), rng.integers(0, classes, 12)
    spec = NetSpec(classes, (5, 3), activation)
    w = first_weights(spec, 4)
    _, gradient = loss_sums(spec, w, x, y)
    for k in range(len(w)):
        step = np.zeros_like(w)
        step[k] = 1e-5
        assert gradient[k] == pytest.approx((loss_sums(spec, w + step, x, y)[0] - loss_sums(spec, w - step, x, y)[0]) / 2e-5, abs=1e-4)


@pytest.mark.parametrize("solver", ["adam", "sgd", "lbfgs"])
def test_solvers_come_near_the_optimum_of_a_convex_problem(solver):
    """Without hidden layers the network is a logistic regression, whose optimum Newton's method finds."""
    x, y = table(seed=1, n=200, d=3)
    z = (x - x.mean(0)) / x.std(0)
    a = np.hstack([z, np.ones((200, 1))])
    w, alpha = np.zeros(4), 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        shrink = alpha * np.array([1, 1, 1, 0.0])
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(shrink), a.T @ (p - y) + shrink * w)
    spec = NetSpec(2, (), alpha=alpha, solver=solver, rate=0.05, epochs=600, tol=1e-7)
    got = fit_asking_here(spec, x, y, np.arange(200))
    assert np.abs(got.proba(x)[:, 1] - 1 / (1 + np.exp(-a @ w))).max() < 0.02


def test_fitting_by_passes_equals_fitting_in_a_task(spark):
    x, y = table()
    sets = frame(spark, x, y, sets=2)
    specs = [NetSpec(2, (6,), "tanh", solver="adam", epochs=4), NetSpec(2, (4, 3), "relu", solver="sgd", schedule="invscaling", rate=0.1, epochs=3), NetSpec(2, (3,), "logistic", solver="lbfgs", epochs=3)]
    jobs = {2 * i + k: (k, s) for i, s in enumerate(specs) for k in (0, 1)}
    here = {(r.job, r.key): r for r in fit_predict(sets, jobs, score_train=True).collect()}
    away = fit_predict(sets, jobs, score_train=True, local_cells=0).collect()
    assert len(here) == len(away) == len(jobs) * ROWS
    assert all(np.allclose(r.proba, here[r.job, r.key].proba, atol=1e-9) for r in away)


CHANGES = [
    {"activation": "tanh"}, {"activation": "logistic"}, {"alpha": "5"}, {"solver": "sgd"}, {"solver": "lbfgs"}, {"learning_rate_init": "0.02"}, {"max_iter": "40"},
    {"n_layers": "2"}, {"layer_0_size": "9"},
]


@pytest.mark.parametrize("change", CHANGES)
def test_every_parameter_changes_the_fit(change):
    x, y = table(seed=2)
    base = {"max_iter": "15", "layer_0_size": "12", "learning_rate_init": "0.01"}
    fits = [fit_asking_here(models.net_spec({**base, **more}), x, y, np.arange(len(y))).proba(x) for more in ({}, change)]
    assert np.abs(fits[0] - fits[1]).max() > 1e-4


def test_schedules_change_the_rate():
    x, y = table(seed=3)
    base = {"solver": "sgd", "learning_rate_init": "0.3", "max_iter": "120", "layer_0_size": "5"}
    fits = {s: fit_asking_here(models.net_spec({**base, "learning_rate": s}), x, y, np.arange(len(y))).proba(x)[:, 1] for s in ("constant", "invscaling", "adaptive")}
    assert np.abs(fits["constant"] - fits["invscaling"]).max() > 1e-3 and np.abs(fits["constant"] - fits["adaptive"]).max() > 1e-6


def test_learns_rings_that_no_line_divides():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 2))
    y = ((x**2).sum(1) > 1.4).astype(int) + ((x**2).sum(1) > 3.5)
    spec = NetSpec(3, (20,), "tanh", rate=0.01, epochs=200)
    model = fit_asking_here(spec, x[:400], y[:400], np.arange(400))
    assert (model.proba(x[400:]).argmax(1) == y[400:]).mean() > 0.9
    assert np.allclose(link(margins(spec, model.weights, x[:3])).sum(1), 1) and math.isfinite(model.weights.sum())


def test_awkward_rows(spark):
    rows = [(0, "a", [1.0, float("nan")], 0, True), (0, "b", [2.0, None], 1, True), (0, None, [1.0, 2.0], 1, False), (0, "c", [None, None], 1, False)]
    sets = spark.createDataFrame(rows, "set int, key string, features array<double>, label int, train boolean")
    for cells in (0, 1 << 20):
        got = fit_predict(sets, {0: (0, NetSpec(2, (3,), epochs=2))}, local_cells=cells).collect()
        assert len(got) == 2 and all(sum(r.proba) == pytest.approx(1) for r in got)
    assert isinstance(next(optimise(NetSpec(), 2, 0)), tuple)
