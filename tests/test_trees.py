"""Trees, forests and boosting: both ways to grow them, plain greedy references, and every parameter."""

from __future__ import annotations

import numpy as np
import pytest

from labelweave.learning import models
from labelweave.learning.jobs import fit_jobs, fit_predict
from labelweave.learning.trees import TreeModel, TreeSpec, draws, fit_here, gradients, job_edges, link

ROWS = 260


def table(n_classes=2, seed=0, n=ROWS, d=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, d)), 2)
    y = (x[:, 0] + 0.7 * x[:, 1] ** 2 + 0.5 * rng.normal(0, 1, n) > 0.6).astype(int) + (n_classes > 2) * (x[:, 2] > 0.5)
    return x, y


def frame(spark, x, y, sets=1, held_out=4):
    rows = [(s, f"k{i}", [float(v) for v in x[i]], int(y[i]), (i + s) % held_out != 0) for s in range(sets) for i in range(len(x))]
    return spark.createDataFrame(rows, "set int, key string, features array<double>, label int, train boolean").repartition(3)


SPECS = {
    "tree": TreeSpec("tree", depth=5, min_leaf=3),
    "entropy": TreeSpec("tree", depth=4, criterion="entropy", balanced=True, min_split=10),
    "random_split": TreeSpec("tree", depth=4, random_split=True, subset="sqrt"),
    "forest": TreeSpec("forest", n_trees=4, depth=4, bootstrap=True, subset="sqrt"),
    "boost": TreeSpec("boost", n_trees=5, depth=3, l2=1.0, l1=0.1, gamma=0.01, min_hessian=1.0, row_share=0.8, column_share=0.6, positive_weight=2.0, bins=16),
    "bayes": TreeSpec("boost", n_trees=3, depth=3, temperature=1.0, noise=0.0, l2=3.0),
    "softmax": TreeSpec("boost", n_classes=3, n_trees=10, depth=2, l2=1.0),
    "three": TreeSpec("tree", n_classes=3, depth=4),
}


def test_growing_by_levels_equals_growing_in_a_task(spark):
    x2, y2 = table()
    x3, y3 = table(3)
    for classes, x, y in ((2, x2, y2), (3, x3, y3)):
        sets = frame(spark, x, y, sets=2)
        chosen = [s for s in SPECS.values() if s.n_classes == classes]
        jobs = {2 * i + k: (k, s) for i, s in enumerate(chosen) for k in (0, 1)}
        here = {(r.job, r.key): r for r in fit_predict(sets, jobs, score_train=True).collect()}
        away = fit_predict(sets, jobs, score_train=True, local_cells=0).collect()
        assert len(here) == len(away) == len(jobs) * ROWS
        for r in away:
            other = here[r.job, r.key]
            assert np.allclose(r.proba, other.proba, atol=1e-9) and r.train == other.train and r.y_true == other.y_true, (jobs[r.job], r.key)
            assert sum(r.proba) == pytest.approx(1) and r.y_pred == int(np.argmax(r.proba))


def test_nodes_that_a_task_holds_are_finished_in_one_pass(spark, monkeypatch):
    """Sets beyond a task, nodes within it: the same trees in two or three passes instead of one per level."""
    from labelweave.learning import trees

    x, y = table()
    chosen = [s for s in SPECS.values() if s.n_classes == 2 and s.kind != "boost"] + [TreeSpec("boost", n_trees=2, depth=4, l2=1.0), TreeSpec("tree")]
    sets = frame(spark, x, y, sets=2)
    jobs = {2 * i + k: (k, s) for i, s in enumerate(chosen) for k in (0, 1)}
    passes = []
    level = trees._grow_level
    monkeypatch.setattr(trees, "_grow_level", lambda *a: passes.append(1) or level(*a))
    here = {(r.job, r.key): r for r in fit_predict(sets, jobs, score_train=True).collect()}
    away = fit_predict(sets, jobs, score_train=True, local_cells=150 * x.shape[1]).collect()
    # a tree without a limit of its depth alone takes more levels
    assert 2 <= len(passes) <= 10
    assert len(here) == len(away) == len(jobs) * ROWS
    for r in away:
        assert np.allclose(r.proba, here[r.job, r.key].proba, atol=1e-9), (jobs[r.job], r.key)


def greedy(spec: TreeSpec, x, stats, edges, depth=0):
    """A tree by plain recursion over all cuts: nested ``(feature, threshold, left, right)`` or a leaf's sums."""
    total = stats.sum(0)

    def loss(s):
        if spec.kind == "boost":
            g = np.sign(s[0]) * max(abs(s[0]) - spec.l1, 0)
            return 0.5 * g * g / (s[1] + spec.l2) if s[1] + spec.l2 > 0 else 0.0
        w = s[:-1].sum()
        return (s[:-1] ** 2).sum() / w if w else 0.0

    best = (0.0, None)
    if depth < spec.depth and total[-1] >= max(2, spec.min_split):
        unit = total[1] + abs(total[0]) if spec.kind == "boost" else total[:-1].sum()
        for f in range(x.shape[1]):
            for t in edges[f]:
                side = x[:, f] <= t
                a, b = stats[side].sum(0), stats[~side].sum(0)
                if min(a[-1], b[-1]) < spec.min_leaf or spec.kind == "boost" and min(a[1], b[1]) < max(spec.min_hessian, 1e-12):
                    continue
                gain = round((loss(a) + loss(b) - loss(total) - spec.gamma) / unit, 9)
                if gain > best[0]:
                    best = (gain, (f, t, side))
    if best[1] is None:
        return total
    f, t, side = best[1]
    return f, t, greedy(spec, x[side], stats[side], edges, depth + 1), greedy(spec, x[~side], stats[~side], edges, depth + 1)


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def edges_of(x, bins):
    return job_edges([np.unique(np.quantile(x[:, f], np.arange(1, 255) / 255, method="inverted_cdf")) for f in range(x.shape[1])], bins)


@pytest.mark.parametrize("more", [{}, {"l2": 2.0, "l1": 0.4}, {"gamma": 0.5, "min_hessian": 3.0}, {"min_leaf": 12, "bins": 9}])
def test_boosting_equals_plain_newton_steps(more):
    x, y = table(seed=3, n=150)
    spec = TreeSpec("boost", n_trees=4, depth=3, rate=0.3, **more)
    edges = edges_of(x, 255)
    model = fit_here(spec, x, y, np.arange(len(y)), edges)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(spec.n_trees):
        p = 1 / (1 + np.exp(-margin))
        stats = np.stack([p - y, p * (1 - p), np.ones(len(y))], 1)
        tree = greedy(spec, x, stats, job_edges(edges, spec.bins))
        for i in range(len(y)):
            g, h, _ = walk(tree, x[i])
            margin[i] -= spec.rate * np.sign(g) * max(abs(g) - spec.l1, 0) / (h + spec.l2)
    assert np.allclose(model.proba(x)[:, 1], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_softmax_boosting_equals_plain_newton_steps_and_its_loss_falls():
    x, y = table(3, seed=4, n=150)
    spec = TreeSpec("boost", n_classes=3, n_trees=6, depth=2, rate=0.3, l2=1.0)
    edges = edges_of(x, 255)
    model = fit_here(spec, x, y, np.arange(len(y)), edges)
    margin = np.repeat(np.log(np.bincount(y) / len(y))[None, :], len(y), axis=0)
    losses = []
    for turn in range(spec.n_trees):
        e = np.exp(margin)
        p = e / e.sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        for k in range(3):
            stats = np.stack([p[:, k] - (y == k), p[:, k] * (1 - p[:, k]), np.ones(len(y))], 1)
            tree = greedy(spec, x, stats, edges)
            for i in range(len(y)):
                g, h, _ = walk(tree, x[i])
                margin[i, k] -= spec.rate * g / (h + spec.l2)
    got = model.proba(x)
    assert np.allclose(got, link(margin), atol=1e-9) and np.allclose(got.sum(1), 1)
    losses.append(-np.log(got[np.arange(len(y)), y]).mean())
    assert all(b < a for a, b in zip(losses, losses[1:]))
    parts = [TreeModel(spec, model.start, model.trees[: 3 * k]).proba(x) for k in range(7)]
    assert np.allclose([-np.log(p[np.arange(len(y)), y]).mean() for p in parts], losses)


def test_tree_equals_plain_gini_splits():
    x, y = table(3, seed=5, n=160)
    spec = TreeSpec("tree", n_classes=3, depth=4, min_leaf=2, min_split=6)
    edges = edges_of(x, 255)
    model = fit_here(spec, x, y, np.arange(len(y)), edges)
    stats = np.hstack([np.eye(3)[y], np.ones((len(y), 1))])
    tree = greedy(spec, x, stats, edges)
    want = np.array([walk(tree, row)[:-1] for row in x])
    assert np.allclose(model.proba(x), want / want.sum(1, keepdims=True))


def test_derivatives_are_those_of_the_loss():
    rng = np.random.default_rng(6)
    for classes in (2, 3):
        spec = TreeSpec("boost", n_classes=classes)
        margin, y = rng.normal(0, 1, (8, spec.outputs)), rng.integers(0, classes, 8)
        loss = lambda m: -np.log(link(m)[np.arange(8), y])
        for k in range(spec.outputs):
            step = np.zeros_like(margin)
            step[:, k] = 1e-4
            g, h = gradients(spec, margin, y, k).T
            assert np.allclose((loss(margin + step) - loss(margin - step)) / 2e-4, g, atol=1e-6)
            assert np.allclose((loss(margin + step) - 2 * loss(margin) + loss(margin - step)) / 1e-8, h, atol=1e-4)


CHANGES = [
    ("xgboost", {"reg_alpha": "2.0"}), ("xgboost", {"reg_lambda": "20"}), ("xgboost", {"gamma": "3"}), ("xgboost", {"min_child_weight": "12"}),
    ("xgboost", {"subsample": "0.6"}), ("xgboost", {"colsample_bytree": "0.5"}), ("xgboost", {"scale_pos_weight": "5"}), ("xgboost", {"max_depth": "2"}),
    ("catboost", {"l2_leaf_reg": "30"}), ("catboost", {"bagging_temperature": "0"}), ("catboost", {"random_strength": "0"}), ("catboost", {"border_count": "4"}),
    ("histogram_gradient_boosting", {"l2_regularization": "9"}), ("histogram_gradient_boosting", {"min_samples_leaf": "2"}),
    ("gradient_boosting", {"min_samples_split": "90"}), ("gradient_boosting", {"max_features": "sqrt"}), ("gradient_boosting", {"learning_rate": "0.5"}),
    ("decision_tree", {"splitter": "random"}), ("decision_tree", {"criterion": "entropy"}), ("decision_tree", {"min_samples_split": "90"}),
    ("decision_tree", {"min_samples_leaf": "20"}), ("decision_tree", {"class_weight": "balanced"}), ("random_forest", {"bootstrap": "False"}),
]
BASE = {"xgboost": {"n_estimators": "4"}, "catboost": {"iterations": "4"}, "histogram_gradient_boosting": {"max_iter": "4"}, "gradient_boosting": {"n_estimators": "4"}, "random_forest": {"n_estimators": "4"}}


@pytest.mark.parametrize(("name", "change"), CHANGES)
def test_every_parameter_changes_the_fit(name, change):
    x, y = table(seed=7)
    edges, base = edges_of(x, 255), BASE.get(name, {})
    probe = table(seed=8)[0]
    fits = [fit_here(models.tree_spec(name, {**base, **more}), x, y, np.arange(len(y)), edges).proba(probe) for more in ({}, change)]
    assert np.abs(fits[0] - fits[1]).max() > 1e-6


def test_awkward_sets(spark):
    nan = float("nan")
    rows = [
        (0, "a", [1.0, nan], 0, True), (0, "b", [1.0, nan], 1, True), (0, "c", [1.0, 2.0], 1, False), (0, "c", [1.0, 2.0], 1, False),
        (1, "a", [3.0, 1.0], 1, True), (1, None, [4.0, 1.0], 1, False),
    ]
    sets = spark.createDataFrame(rows, "set int, key string, features array<double>, label int, train boolean")
    jobs = {0: (0, TreeSpec("tree")), 1: (1, TreeSpec("boost", n_trees=2)), 2: (1, TreeSpec("forest", n_trees=2, bootstrap=True))}
    for cells in (0, 1 << 20):
        got = fit_predict(sets, jobs, local_cells=cells).collect()
        assert len(got) == 4 and [r.proba for r in got if r.job == 0] == [[0.5, 0.5]] * 2
        assert [r.y_pred for r in got if r.job == 1] == [1]
    assert set(fit_jobs(sets, jobs)) == {0, 1, 2}


def test_draws_are_even():
    u = draws(1, 2, np.arange(20_000))
    assert abs(u.mean() - 0.5) < 0.01 and 0 < u.min() and u.max() < 1 and len(np.unique(u)) == 20_000


def test_boosting_by_sums_grows_the_trees_of_sorted_rows(monkeypatch):
    from labelweave.learning import trees

    random = np.random.default_rng(5)
    x = np.round(random.normal(size=(400, 6)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + random.normal(size=400) > 0).astype(int)
    edges = [np.unique(x[:, f])[:-1] for f in range(6)]
    for more in ({}, {"l1": 0.3, "gamma": 0.1, "min_leaf": 7, "row_share": 0.6, "column_share": 0.7}, {"noise": 1.0, "temperature": 1.0, "subset": "sqrt"}):
        spec = TreeSpec("boost", n_trees=4, depth=5, l2=1.0, **more)
        grown, cells = [], []
        count = np.bincount
        for by_sums in (True, False):
            with monkeypatch.context() as patch:
                if not by_sums:
                    patch.setattr(trees, "_grow_by_sums", lambda *a: None)
                patch.setattr(np, "bincount", lambda *a, **k: cells.append(by_sums) or count(*a, **k))
                grown.append(fit_here(spec, x, y, np.arange(400), edges).trees)
        assert cells.count(True) > cells.count(False) + 20
        for a, b in zip(*grown):
            assert all(np.array_equal(p, q) for p, q in zip(a[:3], b[:3])) and np.allclose(a[3], b[3])


def test_jobs_that_pass_over_the_rows_by_turns_take_larger_sets_in_a_task(spark):
    from labelweave.learning import jobs
    from labelweave.learning.networks import NetSpec

    rows = jobs._rows(spark.createDataFrame([(0, str(i), [float(i), 1.0], i % 2, True) for i in range(100)], "set int, key string, features array<double>, label int, train boolean"))
    given = {0: (0, TreeSpec("boost")), 1: (0, TreeSpec("forest")), 2: (0, NetSpec())}
    assert [sorted(jobs._measured(rows, given, cells)[0]) for cells in (200, 199, 25, 24, 0)] == [[0, 1, 2], [0, 2], [0, 2], [], []]
