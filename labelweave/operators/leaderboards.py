"""Rankings and summary tables over trials, folds, models and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.operators.metrics import METRICS
from labelweave.operators.ordering import first_rows, row_numbers


def rank_trials(trials: DataFrame, groups: Sequence[str] = ("model", "fold")) -> DataFrame:
    """Full ranking of trials by score; ties by trial number."""
    return row_numbers(trials, groups, [F.col("score").desc(), F.col("trial")], "rank")


def best_trial(trials: DataFrame, groups: Sequence[str] = ("model", "fold")) -> DataFrame:
    return first_rows(trials, groups, [F.col("score").desc(), F.col("trial")])


def best_fold(folds: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Fold with the highest PR-AUC, the first one on ties."""
    return first_rows(folds, groups, [F.col("pr_auc").desc(), F.col("fold")])


def top_combinations(results: DataFrame, groups: Sequence[str] = ("model",), k: int = 5) -> DataFrame:
    """Best ``k`` (fold, strategy) combinations; rank 1 is the overall best."""
    order = [F.col("pr_auc").desc(), F.col("fold"), F.col("strategy")]
    ranked = first_rows(results, groups, order, k, rank_column="rank")
    return ranked.withColumn("is_best", F.col("rank") == 1)


def top_strategies(
    results: DataFrame, k: int = 3, measure: str = "pr_auc", groups: Sequence[str] = ("model",)
) -> DataFrame:
    """Best ``k`` strategies per model."""
    return first_rows(results, groups, [F.col(measure).desc(), F.col("strategy")], k, rank_column="rank")


def latest_run(runs: DataFrame, column: str = "run") -> DataFrame:
    """Newest run folder; the names start with their time stamp."""
    named = runs.filter(F.col(column).rlike(r"^\d{8}_\d{6}_.*(binary|multiclass)"))
    return named.agg(F.max(column).alias(column))


def fold_table_with_mean(
    rows: DataFrame, groups: Sequence[str], fold: str, values: Sequence[str]
) -> DataFrame:
    """Detail rows per fold plus a mean row (fold ``mean``) per group."""
    detail = rows.select(*groups, F.col(fold).cast("string").alias(fold), *values)
    mean = rows.groupBy(*groups).agg(*[F.avg(v).alias(v) for v in values])
    return detail.unionByName(mean.withColumn(fold, F.lit("mean")))


def importance_pivot(
    long: DataFrame, params: Sequence[str], keys: Sequence[str] = ("model", "fold")
) -> DataFrame:
    """``(model, fold, param, value)`` to one column per parameter, in sorted order."""
    return long.groupBy(*keys).pivot("param", sorted(params)).agg(F.first("value"))


def aggregate_experiments(long: DataFrame, params: Sequence[str]) -> DataFrame:
    """Importances of all runs as one table with a mean row per run and model."""
    wide = importance_pivot(long, params, ("run", "model", "fold"))
    return fold_table_with_mean(wide, ["run", "model"], "fold", sorted(params))


def strategy_leaderboard(results: DataFrame, strategies: Sequence[str], measure: str = "pr_auc") -> DataFrame:
    """Task and model by strategy: one column per strategy."""
    return results.groupBy("task", "model").pivot("strategy", sorted(strategies)).agg(F.max(measure))


def experiment_summary(metrics: DataFrame, metric_names: Sequence[str] = METRICS) -> DataFrame:
    """One row per run and model from long metric rows; failed models (null values) are skipped."""
    present = metrics.filter("value IS NOT NULL")
    return present.groupBy("run", "model").pivot("metric", list(metric_names)).agg(F.first("value"))


def params_by_model_experiment(params: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` (PR-AUC, parameters) per model and run, in fold order."""
    return first_rows(params, ["model", "run"], ["fold"], k, rank_column="position").orderBy(
        "model", "run", "position"
    )
