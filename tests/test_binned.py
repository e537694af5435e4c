"""Trees from the bins of sets beyond a task's rows, from counts and from sibling sums; machines asked together."""

from __future__ import annotations

import numpy as np
import pytest

from labelweave.learning import jobs as J
from labelweave.learning import kernels, trees
from labelweave.learning.kernels import SvmSpec
from labelweave.learning.trees import TreeSpec, fit_here
from tests.test_trees import SPECS, frame, table


def test_binned_sets_grow_the_same_trees_without_passes(spark, monkeypatch):
    x2, y2 = table()
    x3, y3 = table(3)
    extra = [TreeSpec("forest", n_trees=3, bootstrap=True, subset="log2", bins=20), TreeSpec("boost", n_trees=3, depth=5, l2=1.0, bins=300)]
    for classes, x, y in ((2, x2, y2), (3, x3, y3)):
        sets = frame(spark, x, y, sets=2)
        chosen = [s for s in [*SPECS.values(), *extra] if s.n_classes == classes]
        given = {2 * i + k: (k, s) for i, s in enumerate(chosen) for k in (0, 1)}
        for score_train in (True, False):
            here = {(r.job, r.key): r for r in J.fit_predict(sets, given, score_train).collect()}
            with monkeypatch.context() as patch:
                patch.setattr(trees, "_grow_level", lambda *a: pytest.fail("a pass over the rows"))
                near = J.fit_predict(sets, given, score_train, local_cells=10, binned_cells=1 << 20).collect()
            assert len(here) == len(near) > 0
            for r in near:
                other = here[r.job, r.key]
                assert np.allclose(r.proba, other.proba, atol=1e-9) and (r.train, r.y_true, r.y_pred) == (other.train, other.y_true, other.y_pred)


def test_sets_beyond_the_bound_still_pass_over_the_rows(spark):
    x, y = table()
    given = {0: (0, TreeSpec("tree", depth=2))}
    rows = J._rows(frame(spark, x, y))
    assert J._near(rows, given, 10, x.size - 1) == [] and J._near(rows, given, x.size, 1 << 20) == []
    assert J._near(rows, given, 10, x.size) == [(0, given)]


def test_edges_are_the_values_at_their_ranks(spark):
    x, y = table(n=211, d=11)
    rows = J._rows(frame(spark, x, y, sets=2))
    found, known = trees.exact_edges(rows, {0: 255, 1: 7}), trees.set_edges(rows, {0: 255, 1: 7})
    for s, most in ((0, 255), (1, 7)):
        own = x[[(i + s) % 4 != 0 for i in range(len(x))]]
        assert len(found[s]) == 11
        for f, e in enumerate(found[s]):
            assert np.array_equal(e, np.unique(np.quantile(own[:, f], np.arange(1, most) / most, method="inverted_cdf"))) and np.array_equal(e, known[s][f])


def test_counts_grow_the_trees_of_sorted_rows(monkeypatch):
    random = np.random.default_rng(9)
    x = np.round(random.normal(size=(700, 9)), 1)
    score = x[:, 0] + x[:, 1] * x[:, 2] + random.normal(size=700)
    edges = [np.unique(x[:, f])[:-1] for f in range(9)]
    for classes in (2, 3):
        y = np.digitize(score, [1.0, 2.0][: classes - 1])
        for cells in (trees.COUNT_CELLS, 900):
            monkeypatch.setattr(trees, "COUNT_CELLS", cells)
            for more in ({}, {"min_leaf": 9, "min_split": 30}, {"criterion": "entropy", "depth": 6}, {"balanced": True}, {"kind": "forest", "n_trees": 3, "bootstrap": True, "subset": "sqrt", "min_leaf": 3}):
                spec = TreeSpec(**{"kind": "tree", "n_classes": classes, **more})
                by_counts = fit_here(spec, x, y, np.arange(700), edges).trees
                with monkeypatch.context() as patch:
                    patch.setattr(trees, "_classes_of", lambda *a: None)
                    by_rows = fit_here(spec, x, y, np.arange(700), edges).trees
                for a, b in zip(by_counts, by_rows):
                    assert all(np.array_equal(p, q) for p, q in zip(a[:3], b[:3])) and np.allclose(a[3], b[3])


def test_machines_asked_together_answer_as_alone(monkeypatch):
    random = np.random.default_rng(2)
    x, rows = random.normal(size=(300, 5)), np.arange(300) * 977
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 0.5)
    for balanced in (False, True):
        spec = SvmSpec(n_classes=3, landmarks=40, epochs=20, balanced=balanced)
        alone = J.fit_asking_here(spec, x, y, rows)
        with monkeypatch.context() as patch:
            patch.setattr(kernels, "LARGE_MAP", 0)
            patch.setattr(SvmSpec, "answer_one", (lambda own: lambda self, q, kept: own(self, q, kept) if q[1] == "curve" else pytest.fail("asked alone"))(SvmSpec.answer_one))
            together = J.fit_asking_here(spec, x, y, rows)
        assert np.allclose(alone.proba(x), together.proba(x), atol=1e-6)
