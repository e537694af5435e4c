"""The forest that measures importance on many trials."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.learning import search, spaces
from labelweave.learning.regression import best_cuts, bootstrap_counts, feature_edges, grow_forest
from labelweave.learning.trees import draws


def scored(spark, n=3000):
    trials = spaces.trial_table(spark, "s", n, "decision_tree")
    noise = F.pmod(F.hash("trial"), F.lit(1000)) / 10_000
    return trials.withColumn("score", F.col("params")["max_depth"].cast("double") / 32 + F.col("params")["min_samples_leaf"].cast("double") / 40 + noise)


def importance(trials, **more):
    return {r.param: r.value for r in search.param_importance(trials, "decision_tree", trees=10, **more).collect()}


def test_both_forests_agree(spark):
    trials = scored(spark)
    assert importance(trials, most=0) == pytest.approx(importance(trials), abs=0.01)


def test_partitions_do_not_matter(spark):
    trials = scored(spark)
    assert importance(trials.repartition(7), most=0) == pytest.approx(importance(trials.coalesce(1), most=0), abs=1e-9)


def test_trials_beyond_the_bound_do_without_the_forest_of_spark(spark, monkeypatch):
    """Its passes over every trial of every tree took too long for many trials."""
    monkeypatch.setattr(search, "FOREST_TRIALS", 100)
    monkeypatch.setattr(search, "RandomForestRegressor", None)
    got = importance(scored(spark, 500), most=100)
    assert max(got, key=got.get) == "max_depth"


def test_counts_are_poisson():
    u = draws(1, 2, np.arange(200_000))
    for n in (1, 2, 40, 5000):
        counts = bootstrap_counts(u, np.full(len(u), n))
        assert counts.mean() == pytest.approx(n, rel=0.02) and counts.var() == pytest.approx(n, rel=0.02)
    ends = np.array([1e-17, 1 - 2**-53])
    assert (bootstrap_counts(ends, np.array([1, 1])) >= 0).all() and np.isfinite(bootstrap_counts(ends, np.array([10**8, 1]))).all()


def test_copies_are_drawn_as_their_number(spark):
    """Many equal rows, as one row with its number, weigh as much in every tree as so many rows."""
    rows = spark.range(40_000).select((F.col("id") % 2).cast("double").alias("score"), F.array((F.col("id") % 2).cast("double"), F.lit(0.0)).alias("values"))
    for tree in grow_forest(rows, 2, 5, 3):
        leaves = sorted(n["value"] for n in tree if n["feature"] < 0)
        assert leaves == pytest.approx([0.0, 1.0]) and [n["feature"] for n in tree if n["feature"] >= 0] == [0]
        assert tree[0]["value"] == pytest.approx(0.5, abs=0.02) and tree[0]["threshold"] == 0.5


def test_cuts_lie_between_values_or_at_quantiles(spark):
    rows = spark.range(1000).select(F.array((F.col("id") % 3).cast("double"), F.col("id").cast("double")).alias("values"))
    few, many = feature_edges(rows, 2, 32)
    assert few.tolist() == [0.5, 1.5] and len(many) == 31 and np.diff(many).max() < 40


def test_best_cut_is_the_one_of_all_cuts():
    rng = np.random.default_rng(0)
    sums = np.stack([rng.integers(0, 4, (6, 9)).astype(float), rng.normal(size=(6, 9))])
    sums[1][sums[0] == 0] = 0
    gain, cut, left, total = best_cuts(sums)
    for node in range(6):
        w, s = sums[:, node]
        each = [s[: b + 1].sum() ** 2 / w[: b + 1].sum() + s[b + 1 :].sum() ** 2 / w[b + 1 :].sum() - s.sum() ** 2 / w.sum() if w[: b + 1].sum() and w[b + 1 :].sum() else -1 for b in range(8)]
        assert gain[node] == pytest.approx(max(each)) and cut[node] == int(np.argmax(each))
        assert left[:, node] == pytest.approx([w[: cut[node] + 1].sum(), s[: cut[node] + 1].sum()]) and total[0, node] == w.sum()


def test_plain_maps_hold_the_drawn_parameters(spark):
    """Without conditions the map is plain, so that a single parameter is read without drawing the others."""
    studies = spark.range(50).select(F.lit("s").alias("study"), F.col("id").alias("trial"))
    drawn = spaces.sample_trials(studies, "decision_tree")
    one = drawn.filter(F.col("params")["max_depth"] > "20").select("trial")
    assert one._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 2
    assert all(set(r.params) == {p.name for p in spaces.param_space("decision_tree")} and r.params["class_weight"] == "balanced" for r in drawn.collect())
