"""Training, search and evaluation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.learning import models, search, spaces
from labelweave.operators import metrics


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (80, 4)), rng.normal(2.5, 1, (40, 4))])
    rows = [(f"k{i}", [float(v) for v in row], int(i >= 80)) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "key STRING, features ARRAY<DOUBLE>, label INT").cache()


SMALL = {
    "decision_tree": {"max_depth": "3", "max_features": "sqrt"},
    "random_forest": {"n_estimators": "5", "max_depth": "4"},
    "gradient_boosting": {"n_estimators": "3"},
    "histogram_gradient_boosting": {"max_iter": "3", "min_samples_leaf": "2"},
    "catboost": {"iterations": "3", "learning_rate": "0.3"},
    "xgboost": {"n_estimators": "3", "colsample_bytree": "0.6"},
    "k_nearest_neighbors": {"n_neighbors": "3"},
    "multi_layer_perceptron": {"layer_0_size": "6", "max_iter": "40"},
}


@pytest.mark.parametrize("name", SMALL)
def test_families_learn(data, name):
    out = models.fit_model(name, data, SMALL[name])(data)
    assert out.count() == 120
    assert metrics.roc_auc(out.withColumn("m", F.lit(1)), ["m"]).first().roc_auc > 0.85


@pytest.mark.parametrize("kernel", ["linear", "poly", "rbf", "sigmoid"])
def test_svm_kernels(data, kernel):
    out = models.fit_model("svc", data, {"kernel": kernel, "class_weight": "balanced", "degree": "3", "max_iter": "5"})(data)
    probabilities = out.select(F.element_at("proba", 2).alias("p")).agg(F.min("p"), F.max("p")).first()
    assert 0 <= probabilities[0] <= probabilities[1] <= 1
    if kernel != "poly":
        assert metrics.roc_auc(out.withColumn("m", F.lit(1)), ["m"]).first().roc_auc > 0.85


@pytest.mark.parametrize("name", ["gradient_boosting", "svc", "random_forest"])
def test_three_classes(data, name):
    three = data.withColumn("label", F.when(F.get("features", F.lit(0)) > 3, 2).otherwise(F.col("label")))
    params = {"kernel": "linear", "max_iter": "4"} if name == "svc" else {"n_estimators": "3", "max_depth": "3"}
    out = models.fit_model(name, three, params, 3)(three)
    widths = out.select(F.size("proba").alias("w"), F.aggregate("proba", F.lit(0.0), lambda a, x: a + x).alias("s"))
    row = widths.agg(F.min("w"), F.max("w"), F.min("s"), F.max("s")).first()
    assert (row[0], row[1]) == (3, 3) and row[2] == pytest.approx(1) and row[3] == pytest.approx(1)


def test_standardizer_uses_population_deviation(data):
    scaled = models.standardize(data).select(F.posexplode("features").alias("i", "x"))
    for r in scaled.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect():
        assert r.m == pytest.approx(0, abs=1e-9) and r.s == pytest.approx(1)


@pytest.mark.parametrize("reduced", [False, True])
@pytest.mark.parametrize("model", sorted(spaces.FULL))
def test_drawn_parameters_stay_in_bounds(spark, model, reduced):
    rows = spaces.trial_table(spark, "s", 40, model, reduced).collect()
    space = {p.name: p for p in spaces.param_space(model, reduced)}
    seen = {}
    for r in rows:
        for name, text in r.params.items():
            p = space[name]
            seen.setdefault(name, set()).add(text)
            if p.kind in ("choice", "fixed"):
                assert text in p.choices
            else:
                assert p.low <= float(text) <= p.high
            if p.only_if:
                assert r.params[p.only_if[0]] in p.only_if[1]
    assert set(seen) == set(space)


def test_search_and_status(spark, data):
    trials = search.search_trials("decision_tree", data, n_trials=3, inner=2, overrides={"max_depth": "3"})
    rows = trials.collect()
    assert len(rows) == 3 and all(0 < r.score <= 1 and r.params["max_depth"] == "3" for r in rows)
    scored, status = search.holdout_grid(
        "decision_tree", data, [(1, {"max_depth": "2"}), (2, {"max_depth": "not a number"})], ("none", "randomundersampler")
    )
    assert status.filter("status = 'error'").count() == 2
    assert scored.filter("fold = 2").agg(F.max("value")).first()[0] == 0
    assert scored.filter("fold = 1 AND metric = 'roc_auc'").agg(F.min("value")).first()[0] > 0.8


def test_register_model(data):
    def constant(train, params, n_classes, seed):
        return lambda df: df.select("key", F.col("label").alias("y_true"), F.lit(0).alias("y_pred"), F.array(F.lit(1.0), F.lit(0.0)).alias("proba"))

    models.register_model("constant", constant)
    try:
        assert models.fit_model("constant", data)(data).filter("y_pred = 1").count() == 0
        with pytest.raises(ValueError):
            models.fit_model("absent", data)
    finally:
        del models.FAMILIES["constant"]
