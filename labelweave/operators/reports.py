"""Parsing of text reports ``(file_path, run, model, content)`` into tables.

Reports are small texts, one per row; parsing is row-wise and never groups reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.text import strategy_name

# Phrases of the report layouts.
AGGREGATE_HEADING = "AGGREGATED VALIDATION METRICS (MEAN OF 5 FOLDS)"
STRATEGY_HEADING = "BALANCING STRATEGY:"
IMPORTANCE_HEADING = "Importância dos parâmetros (Optuna):"
NUMBER = r"([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"


def _metric(block: Column, name: str) -> Column:
    """Value of a ``name: number`` line, null when there is none."""
    return F.regexp_extract(block, rf"(?m)^[ \t]*{name}:[ \t]+{NUMBER}[ \t]*$", 1).try_cast("double")


def parse_fold_report(reports: DataFrame) -> DataFrame:
    """Aggregated metrics of fold reports, one row per report.

    ``task`` is multiclass when the path says so and the macro metrics are present, else binary.
    Rows without a full set of metrics keep nulls and ``parsed`` is false.
    """
    has_block = F.contains(F.col("content"), F.lit(AGGREGATE_HEADING))
    block = F.when(has_block, F.substring_index("content", AGGREGATE_HEADING, -1))
    said_multi = F.contains(F.col("file_path"), F.lit("/multiclass/"))
    macro = [_metric(F.col("block"), m) for m in ("roc_auc_macro", "pr_auc_macro")]
    plain = [_metric(F.col("block"), m) for m in ("roc_auc", "pr_auc")]
    is_multi = F.col("said_multi") & macro[0].isNotNull() & macro[1].isNotNull()
    parsed = (
        reports.withColumns({"block": block, "said_multi": said_multi})
        .withColumn("task", F.when(is_multi, "multiclass").otherwise("binary"))
        .select(
            "file_path",
            "run",
            "model",
            strategy_name("run").alias("strategy"),
            "task",
            *[_metric(F.col("block"), m).alias(m) for m in ("accuracy", "precision", "recall", "f1")],
            F.when(F.col("task") == "multiclass", macro[0]).otherwise(plain[0]).alias("roc_auc"),
            F.when(F.col("task") == "multiclass", macro[1]).otherwise(plain[1]).alias("pr_auc"),
        )
    )
    values = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")
    complete = F.lit(True)
    for v in values:
        complete = complete & F.col(v).isNotNull()
    return parsed.withColumn("parsed", complete)


def rejected_reports(parsed: DataFrame) -> DataFrame:
    return parsed.filter("NOT parsed").select("file_path")


def parse_literal_dict(column: Column | str) -> Column:
    """``{'a': 1, 'b': 'x', 'c': (3, 4)}`` as a map of texts; quotes around values are removed."""
    text = F.col(column) if isinstance(column, str) else column
    pair = F.lit(r"""['"](\w+)['"]:\s*(\([^)]*\)|'[^']*'|"[^"]*"|[^,}]+)""")
    keys = F.regexp_extract_all(text, pair, F.lit(1))
    values = F.regexp_extract_all(text, pair, F.lit(2))
    return F.map_from_arrays(keys, F.transform(values, lambda v: F.regexp_replace(F.trim(v), r"""^['"]|['"]$""", "")))


def parse_params(reports: DataFrame) -> DataFrame:
    """``(run, model, fold, params, pr_auc)`` of holdout reports in the old and the new layout.

    A section starts at its fold heading; its PR-AUC is the first one it states.
    """
    sections = F.split("content", r"(?m)^[ \t]*(?=(?:Fold|FOLD) \d+:?[ \t]*$)")
    exploded = reports.select("run", "model", F.posexplode(sections).alias("position", "section"))
    literal = F.regexp_extract("section", r"Best Parameters:\s*(\{[^}]*\})", 1)
    return exploded.filter((F.col("position") > 0) & (literal != "")).select(
        "run",
        "model",
        F.regexp_extract("section", r"^(?:Fold|FOLD) (\d+)", 1).cast("int").alias("fold"),
        parse_literal_dict(literal).alias("params"),
        F.regexp_extract("section", rf"PR-AUC:\s*{NUMBER}", 1).try_cast("double").alias("pr_auc"),
    )


def parse_importances(reports: DataFrame) -> DataFrame:
    """``(run, model, fold, param, value)``; the blocks are numbered from 1 in file order."""
    heading = IMPORTANCE_HEADING.replace("(", r"\(").replace(")", r"\)")
    blocks = F.regexp_extract_all("content", F.lit(rf"{heading}\s*\n((?:[ \t]+\w+:[ \t]*[0-9.]+[ \t]*(?:\n|$))+)"), F.lit(1))
    per_fold = reports.select("run", "model", F.posexplode(blocks).alias("position", "block"))
    line = F.lit(r"(\w+):[ \t]*([0-9.]+)")
    pairs = F.arrays_zip(
        F.regexp_extract_all("block", line, F.lit(1)).alias("param"),
        F.regexp_extract_all("block", line, F.lit(2)).alias("value"),
    )
    named = per_fold.select("run", "model", (F.col("position") + 1).alias("fold"), F.explode(pairs).alias("e"))
    return named.select(
        "run", "model", "fold", F.col("e.param").alias("param"), F.col("e.value").try_cast("double").alias("value")
    )


def pending_runs(reports: DataFrame, models: list[str]) -> DataFrame:
    """Old-layout reports of known models: still to be scored with the balancing strategies."""
    old = ~F.contains(F.col("content"), F.lit(STRATEGY_HEADING))
    return reports.filter(old & F.lower("model").isin(models)).select("run", "model")
