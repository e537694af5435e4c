"""Support vector machines: the kernel map, the fit, every parameter."""

from __future__ import annotations

import numpy as np
import pytest

from labelweave.learning import models
from labelweave.learning.jobs import fit_predict
from labelweave.learning.kernels import SvmSpec, kernel_values, nystrom
from labelweave.learning.networks import fit_asking_here
from tests.test_trees import ROWS, frame, table


@pytest.mark.parametrize(("kernel", "shift", "bound"), [("rbf", 0.0, 0.05), ("poly", 0.0, 0.05), ("poly", 1.0, 0.05), ("sigmoid", 0.0, 0.2)])
def test_inner_products_come_near_the_kernel_on_held_out_pairs(kernel, shift, bound):
    x = np.random.default_rng(0).normal(0, 1, (1200, 6))
    mapped = nystrom(kernel, 1 / 6, 3, shift, x[:256])
    want = kernel_values(kernel, x[256:], x[256:], 1 / 6, 3, shift)
    got = mapped(x[256:]) @ mapped(x[256:]).T
    assert np.linalg.norm(got - want) <= bound * np.linalg.norm(want)
    # between landmarks a positive kernel is exact
    if kernel != "sigmoid":
        inside = kernel_values(kernel, x[:256], x[:256], 1 / 6, 3, shift)
        assert np.abs(mapped(x[:256]) @ mapped(x[:256]).T - inside).max() < 1e-5 * np.abs(inside).max()


def test_fit_is_the_optimum_of_the_squared_hinge():
    x, y = table(seed=1, n=160, d=3)
    spec = SvmSpec(kernel="linear", c=0.7, tol=1e-6)
    model = fit_asking_here(spec, x, y, np.arange(160))
    z, sign = (x - x.mean(0)) / x.std(0), np.where(y == 1, 1.0, -1.0)

    def objective(w):
        return 0.5 * w[:-1] @ w[:-1] + 0.7 * (np.maximum(0, 1 - sign * (z @ w[:-1] + w[-1])) ** 2).sum()

    w = model.fitted[0][0]
    rng = np.random.default_rng(2)
    assert all(objective(w) <= objective(w + rng.normal(0, s, 4)) + 1e-6 for s in (1e-3, 1e-2, 0.1, 1.0) for _ in range(50))


@pytest.mark.parametrize("kernel", ["rbf", "poly"])
def test_learns_what_no_line_divides(kernel):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 2))
    y = ((x**2).sum(1) > 1.4).astype(int)
    model = fit_asking_here(SvmSpec(kernel=kernel, degree=2, c=10), x[:400], y[:400], np.arange(400))
    p = model.proba(x[400:])
    assert (p.argmax(1) == y[400:]).mean() > 0.93 and np.allclose(p.sum(1), 1)
    # the curve is calibrated
    assert abs(p[:, 1].mean() - y[400:].mean()) < 0.08


CHANGES = [{"kernel": "linear"}, {"kernel": "poly"}, {"kernel": "sigmoid"}, {"C": "0.01"}, {"class_weight": "balanced"}]


@pytest.mark.parametrize("change", CHANGES)
def test_every_parameter_changes_the_fit(change):
    x, y = table(seed=4)
    fits = [fit_asking_here(models.svm_spec(more), x, y, np.arange(len(y))).proba(x) for more in ({}, change)]
    assert np.abs(fits[0] - fits[1]).max() > 1e-3


def test_degree_shift_and_gamma_change_the_fit():
    x, y = table(seed=5)
    x = np.hstack([x, np.ones((len(x), 1))])
    fit = lambda **p: fit_asking_here(models.svm_spec(p), x, y, np.arange(len(y))).proba(x)
    assert np.abs(fit(kernel="poly", degree="2") - fit(kernel="poly", degree="3")).max() > 1e-3
    assert np.abs(fit(kernel="poly", coef0="1") - fit(kernel="poly")).max() > 1e-3
    # a constant feature tells the two apart
    assert np.abs(fit(gamma="auto") - fit(gamma="scale")).max() > 1e-4


def test_fitting_by_passes_equals_fitting_in_a_task(spark):
    x, y = table()
    sets = frame(spark, x, y)
    jobs = {0: (0, SvmSpec(kernel="rbf", landmarks=40, epochs=4)), 1: (0, SvmSpec(kernel="poly", shift=1.0, degree=2, landmarks=20, epochs=3, balanced=True))}
    here = {(r.job, r.key): r for r in fit_predict(sets, jobs, score_train=True).collect()}
    away = fit_predict(sets, jobs, score_train=True, local_cells=0).collect()
    assert len(here) == len(away) == 2 * ROWS
    assert all(np.allclose(r.proba, here[r.job, r.key].proba, atol=1e-6) for r in away)


def test_three_classes_and_awkward_rows(spark):
    x, y = table(3, seed=6)
    p = fit_asking_here(SvmSpec(3), x, y, np.arange(len(y))).proba(x)
    assert p.shape == (ROWS, 3) and np.allclose(p.sum(1), 1) and (p.argmax(1) == y).mean() > 0.7
    rows = [(0, "a", [1.0, None], 0, True), (0, "a", [1.0, None], 0, True), (0, "b", [2.0, 2.0], 1, True), (0, None, [None, 2.0], 1, False)]
    sets = spark.createDataFrame(rows, "set int, key string, features array<double>, label int, train boolean")
    for cells in (0, 1 << 20):
        (r,) = fit_predict(sets, {0: (0, SvmSpec(epochs=5))}, local_cells=cells).collect()
        assert sum(r.proba) == pytest.approx(1)


def test_machines_are_asked_together():
    x, y = np.random.default_rng(1).normal(size=(60, 3)), np.arange(60) % 3
    spec = SvmSpec(3, landmarks=20)
    aid = spec.aid(x[:20], 3)
    asked, training, answer = [], spec.training(3, 60, np.bincount(y), aid), None
    kept = spec.kept(x, y, np.arange(60), aid)
    try:
        while True:
            question = training.send(answer)
            asked.append(len(question[1]))
            answer = spec.answer(question, kept)
    except StopIteration as end:
        assert len(end.value) == 3
    # three classes, each with its three folds and the whole; then three curves
    assert asked[0] == 12 and asked[-1] <= 3 and 3 in asked
