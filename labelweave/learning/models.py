"""Model families behind one interface: trees, perceptrons and support vector machines fitted together, neighbours by a join.

``fit_model(name, train, params, n_classes)`` standardises on the training rows, fits, and returns a
``Scorer``: a function from rows ``(key, features, label)`` to
``(key, y_true, y_pred, proba ARRAY<DOUBLE>)``.  Parameters are texts, as the search draws them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.learning.jobs import Spec, fit_jobs
from labelweave.learning.kernels import SvmSpec
from labelweave.learning.networks import NetSpec
from labelweave.learning.trees import TreeSpec
from labelweave.operators.neighbors import knn_classify

Scorer = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame, Mapping[str, str], int, int], Scorer]


# ---------------------------------------------------------------- scaling


def fit_standardizer(df: DataFrame, features: str = "features") -> tuple[list[float], list[float]]:
    """Mean and population standard deviation per feature: one aggregate, one row of d numbers."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(features).cast("array<double>")))
    row = df.select(summary.alias("s")).select("s.mean", "s.variance", "s.count").first()
    n = row["count"]
    spread = [math.sqrt(v * (n - 1) / n) if n > 1 else 0.0 for v in row["variance"]]
    return [float(m) for m in row["mean"]], [s or 1.0 for s in spread]


def apply_standardizer(df: DataFrame, fitted: tuple[list[float], list[float]], features: str = "features") -> DataFrame:
    means, spreads = fitted
    scale = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(means, spreads)])
    return df.withColumn(
        features, F.zip_with(F.col(features).cast("array<double>"), scale, lambda x, z: (x - z["m"]) / z["s"])
    )


def standardize(train: DataFrame, df: DataFrame | None = None, features: str = "features") -> DataFrame:
    """z-scores fitted on ``train``, applied to ``df`` (default: to ``train`` itself)."""
    return apply_standardizer(train if df is None else df, fit_standardizer(train, features), features)


# ---------------------------------------------------------------- shared pieces


def _predicted(df: DataFrame, proba: Column) -> DataFrame:
    scored = df.withColumn("proba", proba)
    best = F.array_position("proba", F.array_max("proba")) - 1
    return scored.select("key", F.col("label").alias("y_true"), best.cast("int").alias("y_pred"), "proba")


#: Trees end at this depth where no other is given.
MAX_DEPTH = 30


@dataclass(frozen=True)
class BoostingPreset:
    """Names and defaults under which a boosting family states its parameters; None where it has none."""

    rounds: tuple[str, int]
    rate: float
    depth: tuple[str, int]
    leaf: tuple[str, int] | None = ("min_samples_leaf", 1)
    hessian: tuple[str, float] | None = None
    bins: tuple[str, int] = ("max_bins", 255)
    l2: tuple[str, float] | None = None
    temperature: float = 0.0
    noise: float = 0.0


# Parameter names and defaults of the boosting families.
BOOSTING: dict[str, BoostingPreset] = {
    "gradient_boosting": BoostingPreset(("n_estimators", 100), 0.1, ("max_depth", 3)),
    "histogram_gradient_boosting": BoostingPreset(
        ("max_iter", 100), 0.1, ("max_depth", 5), ("min_samples_leaf", 20), l2=("l2_regularization", 0.0)
    ),
    "catboost": BoostingPreset(
        ("iterations", 1000), 0.03, ("depth", 6), None, bins=("border_count", 254), l2=("l2_leaf_reg", 3.0), temperature=1.0, noise=1.0
    ),
    "xgboost": BoostingPreset(
        ("n_estimators", 100), 0.3, ("max_depth", 6), None, ("min_child_weight", 1.0), ("max_bins", 256), ("reg_lambda", 1.0)
    ),
}


def tree_spec(name: str, params: Mapping[str, str], n_classes: int = 2, seed: int = 42) -> TreeSpec:
    """What a tree family grows with these parameters."""
    shared = dict(
        n_classes=n_classes,
        min_split=int(params.get("min_samples_split", 2)),
        balanced=params.get("class_weight") == "balanced",
        positive_weight=float(params.get("scale_pos_weight", 1.0)),
        seed=seed,
    )
    if name in ("decision_tree", "random_forest"):
        forest = name == "random_forest"
        return TreeSpec(
            "forest" if forest else "tree",
            n_trees=int(params.get("n_estimators", 100)) if forest else 1,
            depth=int(params.get("max_depth", MAX_DEPTH)),
            min_leaf=int(params.get("min_samples_leaf", 1)),
            criterion="gini" if params.get("criterion", "gini") == "gini" else "entropy",
            subset=params.get("max_features", "sqrt" if forest else "None"),
            bootstrap=forest and params.get("bootstrap", "True") == "True",
            random_split=params.get("splitter") == "random",
            bins=int(params.get("max_bins", 255)),
            **shared,
        )
    preset = BOOSTING[name]
    given = lambda known, other: type(known[1])(params.get(*known)) if known else other
    return TreeSpec(
        "boost",
        n_trees=given(preset.rounds, 0),
        rate=float(params.get("learning_rate", preset.rate)),
        depth=given(preset.depth, 0),
        min_leaf=given(preset.leaf, 1),
        min_hessian=given(preset.hessian, 0.0),
        bins=given(preset.bins, 0),
        l2=given(preset.l2, 0.0),
        l1=float(params.get("reg_alpha", 0.0)),
        gamma=float(params.get("gamma", 0.0)),
        row_share=float(params.get("subsample", 1.0)),
        column_share=float(params.get("colsample_bytree", 1.0)),
        subset=params.get("max_features", "None"),
        temperature=float(params.get("bagging_temperature", preset.temperature)),
        noise=float(params.get("random_strength", preset.noise)),
        **shared,
    )


def net_spec(params: Mapping[str, str], n_classes: int = 2, seed: int = 42) -> NetSpec:
    """What a perceptron trains with these parameters."""
    return NetSpec(
        n_classes,
        tuple(int(params.get(f"layer_{i}_size", 100)) for i in range(int(params.get("n_layers", 1)))),
        params.get("activation", "relu"),
        float(params.get("alpha", 1e-4)),
        params.get("solver", "adam"),
        float(params.get("learning_rate_init", 1e-3)),
        params.get("learning_rate", "constant"),
        int(params.get("max_iter", 200)),
        float(params.get("tol", 1e-4)),
        seed,
    )


def svm_spec(params: Mapping[str, str], n_classes: int = 2, seed: int = 42) -> SvmSpec:
    """What a support vector machine fits with these parameters."""
    return SvmSpec(
        n_classes,
        params.get("kernel", "rbf"),
        float(params.get("C", 1.0)),
        int(params.get("degree", 3)),
        params.get("gamma", "scale"),
        float(params.get("coef0", 0.0)),
        epochs=int(params.get("max_iter", 1000)),
        tol=float(params.get("tol", 1e-3)),
        balanced=params.get("class_weight") == "balanced",
        seed=seed,
    )


TREE_FAMILIES = ("decision_tree", "random_forest", *BOOSTING)
#: Families whose jobs :mod:`labelweave.learning.jobs` fits together.
TOGETHER = (*TREE_FAMILIES, "multi_layer_perceptron", "svc")


def job_spec(name: str, params: Mapping[str, str], n_classes: int = 2, seed: int = 42) -> Spec:
    """The job of a family that is fitted together with others."""
    chosen = {**DEFAULT_PARAMS.get(name, {}), **params}
    make = {"multi_layer_perceptron": net_spec, "svc": svm_spec}.get(name)
    return make(chosen, n_classes, seed) if make else tree_spec(name, chosen, n_classes, seed)


# ---------------------------------------------------------------- families


def _fit_job(name: str) -> Fit:
    def fit(train: DataFrame, params: Mapping[str, str], n_classes: int, seed: int) -> Scorer:
        rows = train.select(F.lit(0).alias("set"), "key", "features", "label", F.lit(True).alias("train"))
        model = fit_jobs(rows, {0: (0, job_spec(name, params, n_classes, seed))})[0]
        shared = train.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def proba(column: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.proba(np.stack(column.to_numpy()).astype(float))) if len(column) else [])

        return lambda df: _predicted(df, proba(F.col("features").cast("array<double>")))

    fit.together = True
    return fit


def fit_knn(train: DataFrame, params: Mapping[str, str], n_classes: int, seed: int) -> Scorer:
    rows = train.select("key", "features", "label")

    def score(df: DataFrame) -> DataFrame:
        voted = knn_classify(
            rows,
            df,
            k=int(params.get("n_neighbors", 5)),
            n_classes=n_classes,
            weights=params.get("weights", "uniform"),
            p=int(params.get("p", 2)),
        )
        return df.select("key", F.col("label").alias("y_true")).join(voted, "key")

    return score


# ---------------------------------------------------------------- registry

FAMILIES: dict[str, Fit] = {
    **{name: _fit_job(name) for name in TOGETHER},
    "k_nearest_neighbors": fit_knn,
}

#: Default parameters that differ from a family's own defaults.
DEFAULT_PARAMS: dict[str, dict[str, str]] = {"multi_layer_perceptron": {"max_iter": "1000"}}


def register_model(name: str, fit: Fit) -> None:
    """Add a model family; its search space is registered with ``register_space``."""
    FAMILIES[name] = fit


@dataclass(frozen=True)
class Training:
    """Standardised training rows with their scaler; every trial on the same fold shares one."""

    rows: DataFrame
    scaler: tuple[list[float], list[float]]


def prepare_training(train: DataFrame) -> Training:
    """Fit the scaler; the rows stay a view of ``train``, which should be a staged table when it is
    expensive to compute: learners read it a few times and keep their own compact copy."""
    rows = train.select(
        "key", F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label")
    )
    scaler = fit_standardizer(rows)
    return Training(apply_standardizer(rows, scaler), scaler)


def fit_model(
    name: str,
    train: DataFrame | Training,
    params: Mapping[str, str] | None = None,
    n_classes: int = 2,
    seed: int = 42,
    params_processor: Callable[[dict], dict] | None = None,
) -> Scorer:
    """Standardise on the training rows, fit, and return the scorer of raw rows.

    ``train`` is a frame, or a ``Training`` shared by several fits.
    """
    if name not in FAMILIES:
        raise ValueError(f"unknown model {name!r}; known are {sorted(FAMILIES)}")
    chosen = {**DEFAULT_PARAMS.get(name, {}), **(params or {})}
    if params_processor:
        chosen = params_processor(chosen)
    training = train if isinstance(train, Training) else prepare_training(train)
    scorer = FAMILIES[name](training.rows, chosen, n_classes, seed)
    return lambda df: scorer(apply_standardizer(df.select("key", "features", "label"), training.scaler))


def predict(scorer: Scorer, df: DataFrame) -> DataFrame:
    """Label and probabilities per row."""
    return scorer(df)
