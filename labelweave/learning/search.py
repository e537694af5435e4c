"""Hyper-parameter search, nested cross-validation and evaluation sweeps.

The driver holds job lists, model objects and bounded specifications; rows stay in tables.  All tree and perceptron jobs of a sweep, whatever their
trial, fold or strategy, are fitted together (:mod:`labelweave.learning.jobs`); jobs of other families run as Spark jobs from a bounded pool of
threads.  Predictions go to staged tables that are scored together in one pass grouped by job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.learning.importance import Domain, leaf_boxes, marginal_shares
from labelweave.learning.jobs import BINNED_CELLS, fit_predict
from labelweave.learning.models import FAMILIES, TOGETHER, Training, fit_model, job_spec, prepare_training
from labelweave.learning.regression import grow_forest
from labelweave.learning.spaces import DEFAULT_TRIALS, TRIALS_BY_MODEL, Param, param_space, trial_table
from labelweave.operators import metrics
from labelweave.operators.balance import balance
from labelweave.operators.clean import select_feature_group
from labelweave.operators.leaderboards import best_fold, best_trial
from labelweave.operators.splits import kfold, nested_folds, stratified_holdout, stratified_kfold
from labelweave.runtime import new_path, stage

#: Strategies compared on the holdout rows.
HOLDOUT_STRATEGIES = ("none", "randomundersampler", "smoteenn", "tomeklinks")
#: strategies under the names of the search, which cleans differently after oversampling
SEARCH_STRATEGY = {"smoteenn": "smoteenn_search"}
#: trials up to which Spark's own forest measures importance; it passes over every trial of every tree, which takes too long for more
FOREST_TRIALS = 1 << 20
FOREST_DEPTH = 10


def _task(n_classes: int) -> str:
    return "binary" if n_classes == 2 else "multiclass"


def _balanced(train: DataFrame, strategy: str | None) -> DataFrame:
    rows = train.select("key", "features", "label")
    if strategy in (None, "none"):
        return rows
    return stage(balance(rows, SEARCH_STRATEGY.get(strategy, strategy)), "balanced", rebalance=True)


def run_jobs(jobs: Sequence[tuple[dict, Callable[[], DataFrame]]], parallelism: int = 4) -> tuple[DataFrame | None, list[dict]]:
    """Run jobs in a bounded pool: predictions tagged with their job, and a status row per job.

    A failing job does not stop the others; its status keeps the error.
    """

    def run(item):
        tags, job = item
        try:
            out = job()
            tagged = out.select(*[F.lit(v).alias(c) for c, v in tags.items()], *out.columns)
            return stage(tagged, "job"), {**tags, "status": "ok", "error": ""}
        except Exception as error:  # noqa: BLE001 - the status table records it
            return None, {**tags, "status": "error", "error": f"{type(error).__name__}: {error}"}

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(run, jobs))
    tables = [t for t, _ in results if t is not None]
    united = reduce(DataFrame.unionByName, tables) if tables else None
    return united, [s for _, s in results]


def grown_together(model: str) -> bool:
    """Whether the jobs of a family are fitted together: it is one of those and not registered anew."""
    return model in TOGETHER and getattr(FAMILIES[model], "together", False)


def run_together(
    sets: DataFrame, jobs: Sequence[tuple[dict, int, str, Mapping[str, str]]], n_classes: int, seed: int, score_train: bool = False
) -> tuple[DataFrame | None, list[dict]]:
    """Fit ``(tags, set, model, params)`` jobs together: tagged predictions with ``train``, and a status row per job.

    A job whose parameters cannot be read does not stop the others.
    """
    spark = sets.sparkSession
    specs, statuses = {}, []
    for number, (tags, of_set, model, params) in enumerate(jobs):
        try:
            specs[number] = (of_set, job_spec(model, params, n_classes, seed))
            statuses.append({**tags, "status": "ok", "error": ""})
        except ValueError as error:
            statuses.append({**tags, "status": "error", "error": f"{type(error).__name__}: {error}"})
    if not specs:
        return None, statuses
    names = list(jobs[0][0])
    told = spark.createDataFrame([(n, *[jobs[n][0][c] for c in names]) for n in specs], ["job", *names])
    told = told.select(F.col("job").cast("int").alias("job"), *[F.col(c).cast("int").alias(c) if t == "bigint" else F.col(c) for c, t in told.dtypes[1:]])
    # one row per job
    return fit_predict(sets, specs, score_train, binned_cells=BINNED_CELLS).join(F.broadcast(told), "job").drop("job"), statuses


def _set(train: DataFrame, held: DataFrame, number: int) -> DataFrame:
    columns = [F.lit(number).alias("set"), F.col("key").cast("string").alias("key"), F.col("features").cast("array<double>").alias("features"), "label"]
    return train.select(*columns, F.lit(True).alias("train")).unionByName(held.select(*columns, F.lit(False).alias("train")))


def _fold_sets(folded: DataFrame, n: int, strategy: str | None = None, balancer: Callable[[DataFrame, str | None], DataFrame] | None = None) -> DataFrame:
    """A set per fold: the other folds are its training rows, balanced or not."""
    if strategy in (None, "none"):
        repeated = folded.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return repeated.select("set", F.col("key").cast("string").alias("key"), "features", "label", (F.col("fold") != F.col("set")).alias("train"))
    parts = [_set((balancer or _balanced)(folded.filter(F.col("fold") != i), strategy), folded.filter(F.col("fold") == i), i) for i in range(n)]
    return reduce(DataFrame.unionByName, parts)


def run_status(spark, statuses: Sequence[Mapping]) -> DataFrame:
    """Status rows of a sweep as a table."""
    rows = [(str(s.get("model", "")), str(s.get("strategy", "")), int(s.get("fold", -1)), s["status"], s["error"]) for s in statuses]
    return spark.createDataFrame(rows, "model STRING, strategy STRING, fold INT, status STRING, error STRING")


def search_trials(
    model: str,
    data: DataFrame,
    n_trials: int | None = None,
    inner: int = 5,
    strategy: str | None = None,
    reduced: bool = False,
    n_classes: int = 2,
    study: str = "study",
    seed: int = 42,
    parallelism: int = 4,
    overrides: Mapping[str, str] | None = None,
) -> DataFrame:
    """Trials with the mean inner-fold average precision: ``(study, trial, params, score)``.

    ``overrides`` replaces drawn parameters in every trial.
    """
    spark = data.sparkSession
    n_trials = n_trials or TRIALS_BY_MODEL.get(model, DEFAULT_TRIALS)
    trials = stage(trial_table(spark, study, n_trials, model, reduced, _task(n_classes), seed), "trials")
    drawn = [(r.trial, {**r.params, **(overrides or {})}) for r in trials.orderBy("trial").collect()]
    folded = stage(stratified_kfold(data.select("key", "features", "label"), "key", "label", inner, seed), "inner", rebalance=True)
    if grown_together(model):
        jobs = [({"trial": t, "fold": i}, i, model, p) for t, p in drawn for i in range(inner)]
        predictions, statuses = run_together(_fold_sets(folded, inner, strategy), jobs, n_classes, seed)
    else:
        # each training fold is balanced and its scaler fitted once, not once per trial
        train = {i: prepare_training(_balanced(folded.filter(F.col("fold") != i), strategy)) for i in range(inner)}

        def job(params, i):
            return lambda: fit_model(model, train[i], params, n_classes, seed)(folded.filter(F.col("fold") == i))

        predictions, statuses = run_jobs([({"trial": t, "fold": i}, job(p, i)) for t, p in drawn for i in range(inner)], parallelism)
    if predictions is None:
        raise RuntimeError(f"every trial failed: {statuses[0]['error']}")
    complete = _trial_scores(predictions, ["trial"], inner, n_classes)
    return _overridden(trials, overrides).join(complete, "trial").select("study", "trial", "params", "score")


def _trial_scores(predictions: DataFrame, trial: list[str], inner: int, n_classes: int) -> DataFrame:
    """Mean score over the inner folds of the trials of which every fold was fitted."""
    groups = [*trial, "fold"]
    if n_classes == 2:
        scores = metrics.average_precision(predictions, groups).withColumnRenamed("average_precision", "score")
    else:
        scores = metrics.averaged_auc(predictions, groups).select(*groups, F.col("pr_auc_macro").alias("score"))
    mean = scores.groupBy(*trial).agg(F.avg("score").alias("score"), F.count("*").alias("folds"))
    return mean.filter(F.col("folds") == inner).select(*[F.col(c).cast("bigint").alias(c) for c in trial], "score")


def _overridden(trials: DataFrame, overrides: Mapping[str, str] | None) -> DataFrame:
    for name, value in (overrides or {}).items():
        trials = trials.withColumn("params", F.map_concat(_without(name), F.create_map(F.lit(name), F.lit(value))))
    return trials


def _without(name: str) -> Column:
    return F.map_filter("params", lambda k, v: k != F.lit(name))


def param_domain(p: Param) -> Domain:
    """Where a search parameter is drawn from; choices by their number, logarithmic ones by their logarithm."""
    if p.kind == "choice":
        return Domain(tuple(float(i) for i in range(len(p.choices))))
    if p.kind == "int" or p.step:
        return Domain(tuple(p.low + i * p.step for i in range(int((p.high - p.low) / p.step + 1e-9) + 1)))
    return Domain((), math.log(p.low), math.log(p.high)) if p.log else Domain((), p.low, p.high)


def _forest_nodes(ready: DataFrame, trees: int, seed: int) -> list[list[dict]]:
    """The nodes of Spark's forest for ``score`` by ``vector``."""
    forest = RandomForestRegressor(featuresCol="vector", labelCol="score", numTrees=trees, maxDepth=FOREST_DEPTH, seed=seed, featureSubsetStrategy="all").fit(ready)
    nodes: dict[int, list[dict]] = {}
    path = new_path(ready.sparkSession, "forest")
    forest.write().save(path)
    node = "nodeData."
    kept = [F.col(f"{node}{c}").alias(n) for c, n in (("id", "id"), ("leftChild", "left"), ("rightChild", "right"), ("prediction", "value"), ("split.featureIndex", "feature"))]
    threshold = F.try_element_at(f"{node}split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold")
    for r in ready.sparkSession.read.parquet(f"{path}/data").select("treeID", *kept, threshold).toLocalIterator():
        nodes.setdefault(r.treeID, []).append({**r.asDict(), "feature": r.feature if r.left >= 0 else -1})
    return list(nodes.values())


def param_importance(trials: DataFrame, model: str, reduced: bool = False, task: str = "binary", seed: int = 42, trees: int = 50, most: int = FOREST_TRIALS) -> DataFrame:
    """Importance of every varying parameter for the score, by functional analysis of variance: ``(param, value)``.

    A random forest is fitted on the trials; the value is the mean share of a tree's variance over the search space that the parameter explains
    alone.  A parameter that a trial does not use, or that cannot be read, counts as its lowest value or first choice; trials without a score are left
    out.  Spark's own forest is grown on up to ``most`` trials, one from sums over bins on more: of the same depth, bins and bootstrap, with other
    draws.  The driver holds the forest's nodes.
    """
    space = [p for p in param_space(model, reduced, task) if p.kind != "fixed"]

    def value(p: Param) -> Column:
        text = F.col("params")[p.name]
        if p.kind == "choice":
            return F.greatest(F.array_position(F.array(*[F.lit(c) for c in p.choices]), F.coalesce(text, F.lit(p.choices[0]))).cast("double") - 1, F.lit(0.0))
        number = F.coalesce(text.try_cast("double"), F.lit(float(p.low)))
        return F.ln(number) if p.log else number

    wide = trials.filter("score IS NOT NULL AND NOT isnan(score)").select("score", F.array(*[value(p) for p in space]).alias("values"))
    ready = stage(wide.select(F.col("score").cast("double").alias("score"), array_to_vector("values").alias("vector")), "trial_values")
    if ready.count() <= most:
        nodes = _forest_nodes(ready, trees, seed)
    else:
        nodes = grow_forest(ready.select("score", vector_to_array("vector").alias("values")), len(space), trees, FOREST_DEPTH, seed=seed)
    domains = [param_domain(p) for p in space]
    shares = [marginal_shares(*leaf_boxes(tree, len(space)), domains) for tree in nodes]
    values = [(p.name, float(v)) for p, v in zip(space, np.mean(shares, 0))]
    return trials.sparkSession.createDataFrame(values, "param STRING, value DOUBLE")


def _scored(predictions: DataFrame, groups: Sequence[str], n_classes: int) -> DataFrame:
    return metrics.long_metrics(metrics.all_metrics(predictions, groups, _task(n_classes)), groups)


def nested_cv(
    model: str,
    data: DataFrame,
    n_trials: int | None = None,
    outer: int = 5,
    inner: int = 5,
    strategy: str | None = None,
    reduced: bool = False,
    n_classes: int = 2,
    refit_balanced: bool = False,
    seed: int = 42,
    parallelism: int = 4,
    overrides: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Outer folds, each with its own search: metrics ``(fold, split, metric, value)`` and the
    best trial per fold ``(fold, trial, params, score)``.

    By default the winner is refitted on the unbalanced fold, as the trials' balancing is part of
    the search only.
    """
    if grown_together(model):
        return _nested_together(model, data, n_trials, outer, inner, strategy, reduced, n_classes, refit_balanced, seed, overrides)
    folded = stage(stratified_kfold(data.select("key", "features", "label"), "key", "label", outer, seed), "outer", rebalance=True)
    bests, jobs = [], []
    for i in range(outer):
        train, test = folded.filter(F.col("fold") != i), folded.filter(F.col("fold") == i)
        trials = search_trials(
            model, train, n_trials, inner, strategy, reduced, n_classes, f"{model}_{i}", seed, parallelism, overrides
        )
        best = stage(best_trial(trials.withColumn("fold", F.lit(i)), ["fold"]), "best")
        bests.append(best)
        params = best.first().params
        scorer = fit_model(model, _balanced(train, strategy if refit_balanced else None), params, n_classes, seed)
        jobs.append(({"fold": i, "split": "train"}, lambda s=scorer, d=train: s(d)))
        jobs.append(({"fold": i, "split": "test"}, lambda s=scorer, d=test: s(d)))
    predictions, statuses = run_jobs(jobs, parallelism)
    if predictions is None:
        raise RuntimeError(statuses[0]["error"])
    return _scored(predictions, ["fold", "split"], n_classes), reduce(DataFrame.unionByName, bests)


def _nested_together(model, data, n_trials, outer, inner, strategy, reduced, n_classes, refit_balanced, seed, overrides) -> tuple[DataFrame, DataFrame]:
    """Nested folds of a family whose jobs are fitted together: one pass fits every trial on every inner fold of every outer fold, a second one the winners."""
    spark = data.sparkSession
    n_trials = n_trials or TRIALS_BY_MODEL.get(model, DEFAULT_TRIALS)
    nested = stage(nested_folds(data.select("key", "features", "label"), "key", "label", outer, inner, seed), "nested", rebalance=True)
    training = nested.filter("role = 'train'")
    if strategy in (None, "none"):
        repeated = training.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))))
        number = (F.col("outer_fold") * inner + F.col("_j")).cast("int").alias("set")
        sets = repeated.select(number, F.col("key").cast("string").alias("key"), "features", "label", (F.col("inner_fold") != F.col("_j")).alias("train"))
    else:
        parts = []
        for i in range(outer):
            rows = training.filter(F.col("outer_fold") == i)
            for j in range(inner):
                held = F.col("inner_fold") == j
                parts.append(_set(_balanced(rows.filter(~held), strategy), rows.filter(held), i * inner + j))
        sets = reduce(DataFrame.unionByName, parts)
    tables = [trial_table(spark, f"{model}_{i}", n_trials, model, reduced, _task(n_classes), seed).withColumn("outer", F.lit(i)) for i in range(outer)]
    trials = stage(_overridden(reduce(DataFrame.unionByName, tables), overrides), "trials")
    drawn = [(r.outer, r.trial, dict(r.params)) for r in trials.orderBy("outer", "trial").toLocalIterator()]
    jobs = [({"outer": i, "trial": t, "fold": j}, i * inner + j, model, p) for i, t, p in drawn for j in range(inner)]
    predictions, statuses = run_together(sets, jobs, n_classes, seed)
    if predictions is None:
        raise RuntimeError(f"every trial failed: {statuses[0]['error']}")
    scores = _trial_scores(predictions, ["outer", "trial"], inner, n_classes)
    ranked = trials.join(scores, ["outer", "trial"]).withColumn("fold", F.col("outer").cast("int")).select("study", "trial", "params", "score", "fold")
    bests = stage(best_trial(ranked, ["fold"]), "best")
    chosen = {r.fold: dict(r.params) for r in bests.collect()}
    if refit_balanced and strategy not in (None, "none"):
        whole = nested.withColumnRenamed("outer_fold", "fold")
        parts = [_set(_balanced(whole.filter((F.col("fold") == i) & (F.col("role") == "train")), strategy), whole.filter((F.col("fold") == i) & (F.col("role") == "test")), i) for i in range(outer)]
        again = reduce(DataFrame.unionByName, parts)
    else:
        again = nested.select(F.col("outer_fold").cast("int").alias("set"), F.col("key").cast("string").alias("key"), "features", "label", (F.col("role") == "train").alias("train"))
    refits = [({"fold": i}, i, model, p) for i, p in sorted(chosen.items())]
    refitted, statuses = run_together(again, refits, n_classes, seed, score_train=True)
    if refitted is None:
        raise RuntimeError(statuses[0]["error"])
    split = F.when(F.col("train"), "train").otherwise("test")
    return _scored(refitted.withColumn("split", split).drop("train"), ["fold", "split"], n_classes), bests


def holdout_grid(
    model: str,
    data: DataFrame,
    fold_params: Sequence[tuple[int, Mapping[str, str]]],
    strategies: Sequence[str] = HOLDOUT_STRATEGIES,
    n_classes: int = 2,
    seed: int = 42,
    parallelism: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Every fold's parameters with every strategy, fitted on 80 %, scored on 20 %.

    Returns metrics ``(model, fold, strategy, metric, value)``, zero where a job failed, and the
    status table.
    """
    spark = data.sparkSession
    split = stage(stratified_holdout(data.select("key", "features", "label"), "key", "label", 0.2, seed), "holdout", rebalance=True)
    train, test = split.filter("NOT is_test"), split.filter("is_test")
    if grown_together(model):
        sets = reduce(DataFrame.unionByName, [_set(_balanced(train, s), test, i) for i, s in enumerate(strategies)])
        jobs = [({"model": model, "fold": fold, "strategy": s}, i, model, params) for fold, params in fold_params for i, s in enumerate(strategies)]
        return _grid_scores(spark, *run_together(sets, jobs, n_classes, seed), n_classes)
    balanced: dict[str, Training | Exception] = {}
    for strategy in strategies:
        try:
            balanced[strategy] = prepare_training(_balanced(train, strategy))
        except Exception as error:  # noqa: BLE001 - the jobs of the strategy report it
            balanced[strategy] = error

    def job(strategy: str, params: Mapping[str, str]):
        def run() -> DataFrame:
            training = balanced[strategy]
            if isinstance(training, Exception):
                raise training
            return fit_model(model, training, params, n_classes, seed)(test)

        return run

    jobs = [
        ({"model": model, "fold": fold, "strategy": s}, job(s, params)) for fold, params in fold_params for s in strategies
    ]
    return _grid_scores(spark, *run_jobs(jobs, parallelism), n_classes)


def _grid_scores(spark, predictions: DataFrame | None, statuses: list[dict], n_classes: int) -> tuple[DataFrame, DataFrame]:
    status = run_status(spark, statuses)
    wanted = status.select("model", "fold", "strategy").select(
        "*", F.explode(F.array(*[F.lit(m) for m in metrics.METRICS])).alias("metric")
    )
    keys = ["model", "fold", "strategy", "metric"]
    if predictions is None:
        return wanted.withColumn("value", F.lit(0.0)), status
    scored = _scored(predictions, ["model", "fold", "strategy"], n_classes)
    return wanted.join(scored, keys, "left").withColumn("value", F.coalesce("value", F.lit(0.0))), status


def refit_best(
    model: str,
    data: DataFrame,
    folds: DataFrame,
    fold_params: Mapping[int, Mapping[str, str]],
    n_classes: int = 2,
    seed: int = 42,
) -> DataFrame:
    """Parameters of the best fold refitted on the whole 80 %, predictions of the 20 %.

    ``folds`` is ``(model, fold, pr_auc)``.
    """
    chosen = best_fold(folds, ["model"]).first().fold
    split = stage(stratified_holdout(data.select("key", "features", "label"), "key", "label", 0.2, seed), "holdout", rebalance=True)
    scorer = fit_model(model, split.filter("NOT is_test"), fold_params[chosen], n_classes, seed)
    return scorer(split.filter("is_test"))


def evaluate_default(
    models: Mapping[str, Mapping[str, str]] | Sequence[str],
    data: DataFrame,
    strategy: str = "none",
    n_folds: int = 5,
    n_classes: int = 2,
    seed: int = 42,
    parallelism: int = 4,
    keep_predictions: bool = False,
) -> tuple[DataFrame, DataFrame] | tuple[DataFrame, DataFrame, DataFrame]:
    """Models with default parameters on the holdout and by unstratified folds of the 80 %.

    Returns metrics ``(model, strategy, fold, split, metric, value)`` and the status table; fold -1
    is the holdout.
    """
    given = models if isinstance(models, Mapping) else {m: {} for m in models}
    split = stage(stratified_holdout(data.select("key", "features", "label"), "key", "label", 0.2, seed), "holdout", rebalance=True)
    train_full, test = split.filter("NOT is_test"), split.filter("is_test")
    folded = stage(kfold(train_full.select("key", "features", "label"), "key", n_folds, seed), "folds", rebalance=True)
    sets = {-1: (train_full, test)}
    for i in range(n_folds):
        sets[i] = (folded.filter(F.col("fold") != i), folded.filter(F.col("fold") == i))
    sets = {i: (_balanced_default(train, strategy), held) for i, (train, held) in sets.items()}
    together = [m for m in given if grown_together(m)]
    others = {m: p for m, p in given.items() if m not in together}
    trainings = {i: prepare_training(train) for i, (train, _) in sets.items()} if others else {}

    def job(model: str, params: Mapping[str, str], fold: int):
        def run() -> DataFrame:
            train, held = sets[fold]
            scorer = fit_model(model, trainings[fold], params, n_classes, seed)
            return scorer(train).withColumn("split", F.lit("train")).unionByName(
                scorer(held).withColumn("split", F.lit("valid" if fold >= 0 else "test"))
            )

        return run

    tags = lambda m, fold: {"model": m, "strategy": strategy, "fold": fold}
    predictions, statuses = run_jobs([(tags(m, fold), job(m, params, fold)) for m, params in others.items() for fold in sets], parallelism)
    if together:
        united = reduce(DataFrame.unionByName, [_set(train, held, i) for i, (train, held) in sets.items()])
        grown, more = run_together(united, [(tags(m, i), i, m, given[m]) for m in together for i in sets], n_classes, seed, score_train=True)
        statuses += more
        if grown is not None:
            split = F.when(F.col("train"), "train").when(F.col("fold") >= 0, "valid").otherwise("test")
            grown = grown.withColumn("split", split).drop("train")
            predictions = grown if predictions is None else predictions.withColumn("key", F.col("key").cast("string")).unionByName(grown)
    status = run_status(data.sparkSession, statuses)
    if predictions is None:
        raise RuntimeError(statuses[0]["error"])
    scored = _scored(predictions, ["model", "strategy", "fold", "split"], n_classes)
    return (scored, status, predictions) if keep_predictions else (scored, status)


def _balanced_default(train: DataFrame, strategy: str) -> DataFrame:
    rows = train.select(F.col("key").cast("string").alias("key"), "features", "label")
    return stage(balance(rows, strategy), "balanced", rebalance=True)


def feature_group_cv(
    models: Sequence[str] | Mapping[str, Mapping[str, str]],
    data: DataFrame,
    groups: Sequence[str],
    n_folds: int = 5,
    n_classes: int = 2,
    seed: int = 42,
    parallelism: int = 4,
) -> DataFrame:
    """Stratified folds on named feature groups, with plain and balanced class weights.

    ``(model, feature_group, weighting, fold, split, metric, value)``.
    """
    given = models if isinstance(models, Mapping) else {m: {} for m in models}
    folded = stage(stratified_kfold(data.select("key", "features", "label"), "key", "label", n_folds, seed), "folds", rebalance=True)
    jobs = []
    together = [m for m in given if grown_together(m)]
    others = {m: p for m, p in given.items() if m not in together}
    weightings = {"plain": {}, "balanced": {"class_weight": "balanced"}}
    predictions = None
    if together:
        columns = [F.col("key").cast("string").alias("key"), "label", "fold"]
        parts = [select_feature_group(folded, "features", g).select(*columns, "features", F.lit(k).alias("_g")) for k, g in enumerate(groups)]
        repeated = reduce(DataFrame.unionByName, parts).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
        sets = repeated.select((F.col("_g") * n_folds + F.col("_i")).cast("int").alias("set"), "key", "features", "label", (F.col("fold") != F.col("_i")).alias("train"))
        its_jobs = [
            ({"model": m, "feature_group": g, "weighting": w, "fold": i}, k * n_folds + i, m, {**given[m], **extra})
            for k, g in enumerate(groups) for i in range(n_folds) for m in together for w, extra in weightings.items()
        ]
        predictions, statuses = run_together(sets, its_jobs, n_classes, seed, score_train=True)
        if predictions is None:
            raise RuntimeError(statuses[0]["error"])
        predictions = predictions.withColumn("split", F.when(F.col("train"), "train").otherwise("test")).drop("train")
    for group in groups if others else ():
        part = stage(select_feature_group(folded, "features", group), "group", rebalance=True)
        for i in range(n_folds):
            train, held = part.filter(F.col("fold") != i), part.filter(F.col("fold") == i)
            training = prepare_training(train)
            for model, params in others.items():
                for weighting, extra in weightings.items():

                    def run(model=model, params=params, extra=extra, training=training, train=train, held=held):
                        scorer = fit_model(model, training, {**params, **extra}, n_classes, seed)
                        return scorer(train).withColumn("split", F.lit("train")).unionByName(
                            scorer(held).withColumn("split", F.lit("test"))
                        )

                    jobs.append(({"model": model, "feature_group": group, "weighting": weighting, "fold": i}, run))
    if jobs:
        more, statuses = run_jobs(jobs, parallelism)
        if more is not None:
            more = more.withColumn("key", F.col("key").cast("string"))
            predictions = more if predictions is None else predictions.unionByName(more)
    if predictions is None:
        raise RuntimeError(statuses[0]["error"])
    return _scored(predictions, ["model", "feature_group", "weighting", "fold", "split"], n_classes)
