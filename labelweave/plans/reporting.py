"""Report folders to leaderboards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from labelweave.operators.leaderboards import params_by_model_experiment, top_strategies
from labelweave.operators.reports import parse_fold_report, parse_params, pending_runs, rejected_reports
from labelweave.runtime import stage


@dataclass(frozen=True)
class FoldReports:
    """Tables from fold reports; ``top`` ranks the strategies of every task and model."""

    parsed: DataFrame
    rejected: DataFrame
    top: DataFrame


def compile_fold_reports(reports: DataFrame, k: int = 3) -> FoldReports:
    """Metrics of all reports, the reports without metrics, and the best strategies."""
    parsed = stage(parse_fold_report(reports), "parsed")
    complete = parsed.filter("parsed")
    return FoldReports(parsed, rejected_reports(parsed), top_strategies(complete, k, groups=("task", "model")))


@dataclass(frozen=True)
class HoldoutReports:
    """Tables from holdout reports: parameters per model and run, and runs still to re-score."""

    params: DataFrame
    pending: DataFrame


def compile_holdout_reports(reports: DataFrame, models: list[str], k: int = 5) -> HoldoutReports:
    return HoldoutReports(params_by_model_experiment(parse_params(reports), k), pending_runs(reports, models))
