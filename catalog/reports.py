"""Ranking, leaderboard and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import FOLDS, TRIALS, query, rounded, rows, table, with_inputs
from catalog.sources import MEASURES, long_folds
from labelweave.functions.text import parse_run_folder, run_folder_name, strategy_name
from labelweave.operators import leaderboards, reports
from labelweave.plans.reporting import compile_fold_reports as compile_folds
from labelweave.runtime import new_path
from labelweave.sources import readers

# ---------------------------------------------------------------- rankings


@query(
    "rank_trials",
    with_inputs(
        "SELECT model, fold, trial, round(score, 6) AS score, row_number() OVER (PARTITION BY model, fold ORDER BY score DESC, trial) AS rank FROM t",
        t=TRIALS,
    ),
)
def rank_trials(spark, folder):
    return rounded(leaderboards.rank_trials(rows(spark, folder, TRIALS)))


@query(
    "best_trial",
    with_inputs(
        "SELECT model, fold, trial, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY model, fold ORDER BY score DESC, trial) = 1",
        t=TRIALS,
    ),
)
def best_trial(spark, folder):
    return rounded(leaderboards.best_trial(rows(spark, folder, TRIALS)))


MODEL_FOLDS = "SELECT model, fold, avg(pr_auc) AS pr_auc FROM f GROUP BY model, fold"


@query(
    "best_fold",
    with_inputs(
        "SELECT model, fold, round(pr_auc, 6) AS pr_auc FROM m QUALIFY row_number() OVER (PARTITION BY model ORDER BY pr_auc DESC, fold) = 1",
        f=FOLDS,
        m=MODEL_FOLDS,
    ),
)
def best_fold(spark, folder):
    folds = rows(spark, folder, FOLDS).groupBy("model", "fold").agg(F.avg("pr_auc").alias("pr_auc"))
    return rounded(leaderboards.best_fold(folds))


@query(
    "top_combinations",
    with_inputs(
        """SELECT model, fold, strategy, round(pr_auc, 6) AS pr_auc, rank::INT AS rank, rank = 1 AS is_best FROM
        (SELECT *, row_number() OVER (PARTITION BY model ORDER BY pr_auc DESC, fold, strategy) AS rank FROM f) WHERE rank <= 5""",
        f=FOLDS,
    ),
)
def top_combinations(spark, folder):
    return rounded(leaderboards.top_combinations(rows(spark, folder, FOLDS).select("model", "fold", "strategy", "pr_auc")))


STRATEGY_MEANS = "SELECT model, strategy, avg(pr_auc) AS pr_auc FROM f GROUP BY model, strategy"


def strategy_means(spark, folder):
    return rows(spark, folder, FOLDS).groupBy("model", "strategy").agg(F.avg("pr_auc").alias("pr_auc"))


@query(
    "top_strategies",
    with_inputs(
        """SELECT model, strategy, round(pr_auc, 6) AS pr_auc, rank::INT AS rank FROM
        (SELECT *, row_number() OVER (PARTITION BY model ORDER BY pr_auc DESC, strategy) AS rank FROM m) WHERE rank <= 3""",
        f=FOLDS,
        m=STRATEGY_MEANS,
    ),
)
def top_strategies(spark, folder):
    return rounded(leaderboards.top_strategies(strategy_means(spark, folder)))


@query(
    "fold_table_with_mean",
    with_inputs(
        """SELECT model, strategy, CAST(fold AS VARCHAR) AS fold, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM f
        UNION ALL SELECT model, strategy, 'mean', round(avg(roc_auc), 6), round(avg(pr_auc), 6) FROM f GROUP BY model, strategy""",
        f=FOLDS,
    ),
)
def fold_table_with_mean(spark, folder):
    return rounded(leaderboards.fold_table_with_mean(rows(spark, folder, FOLDS), ["model", "strategy"], "fold", ["roc_auc", "pr_auc"]))


ROUNDED_MEASURES = ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)


@query("importance_pivot", with_inputs(f"SELECT strategy AS run, model, fold, {ROUNDED_MEASURES} FROM f", f=FOLDS))
def importance_pivot(spark, folder):
    long = long_folds(spark, folder).withColumnRenamed("metric", "param")
    return rounded(leaderboards.importance_pivot(long, MEASURES, ("run", "model", "fold")))


AVG_MEASURES = ", ".join(f"round(avg({m}), 6) AS {m}" for m in MEASURES)


@query(
    "aggregate_experiments",
    with_inputs(
        f"""SELECT strategy AS run, model, CAST(fold AS VARCHAR) AS fold, {ROUNDED_MEASURES} FROM f
        UNION ALL SELECT strategy, model, 'mean', {AVG_MEASURES} FROM f GROUP BY strategy, model""",
        f=FOLDS,
    ),
)
def aggregate_experiments(spark, folder):
    long = long_folds(spark, folder).withColumnRenamed("metric", "param")
    return rounded(leaderboards.aggregate_experiments(long, MEASURES))


@query("experiment_summary", with_inputs(f"SELECT strategy AS run, model, {AVG_MEASURES} FROM f GROUP BY strategy, model", f=FOLDS))
def experiment_summary(spark, folder):
    means = long_folds(spark, folder).groupBy("run", "model", "metric").agg(F.avg("value").alias("value"))
    return rounded(leaderboards.experiment_summary(means, MEASURES))


@query(
    "strategy_leaderboard",
    with_inputs(
        """SELECT 'binary' AS task, model, round(max(pr_auc) FILTER (strategy = 'A'), 6) AS "A", round(max(pr_auc) FILTER (strategy = 'N'), 6) AS "N",
        round(max(pr_auc) FILTER (strategy = 'R'), 6) AS "R" FROM m GROUP BY model""",
        f=FOLDS,
        m=STRATEGY_MEANS,
    ),
)
def strategy_leaderboard(spark, folder):
    results = strategy_means(spark, folder).withColumn("task", F.lit("binary"))
    return rounded(leaderboards.strategy_leaderboard(results, ["A", "N", "R"]))


# ---------------------------------------------------------------- run names

STRATEGY = "CASE o_orderstatus WHEN 'F' THEN 'smoteenn' WHEN 'O' THEN 'randomundersampler' ELSE 'none' END"
RUN_NAMES = f"""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_src_default_binary' ||
CASE WHEN {STRATEGY} = 'none' THEN '' ELSE '_' || {STRATEGY} END || CASE WHEN o_orderpriority = '5-LOW' THEN '_less' ELSE '' END AS run FROM orders"""


def run_names(spark, folder):
    orders = table(spark, folder, "orders")
    name = run_folder_name(
        F.col("o_orderdate"),
        F.lit("SRC"),
        F.lit("default"),
        F.lit("binary"),
        F.expr(STRATEGY),
        F.col("o_orderpriority") == "5-LOW",
    )
    return orders.select("o_orderkey", name.alias("run"))


@query("run_folder_name", RUN_NAMES)
def run_folder_name_query(spark, folder):
    return run_names(spark, folder)


@query(
    "parse_run_folder",
    f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started, 'src' AS source, 'default' AS mode, 'binary' AS task,
    {STRATEGY} AS strategy, o_orderpriority = '5-LOW' AS reduced FROM orders""",
)
def parse_run_folder_query(spark, folder):
    parsed = run_names(spark, folder).select("o_orderkey", parse_run_folder("run").alias("p")).select("o_orderkey", "p.*")
    return parsed.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


@query("latest_run", f"SELECT max(run) AS run FROM ({RUN_NAMES})")
def latest_run(spark, folder):
    return leaderboards.latest_run(run_names(spark, folder))


@query(
    "strategy_name",
    f"SELECT o_orderkey, replace(regexp_extract(run, '_([^_]+)$', 1), 'randomundersampler', 'rundersampler') AS strategy FROM ({RUN_NAMES})",
)
def strategy_name_query(spark, folder):
    return run_names(spark, folder).select("o_orderkey", strategy_name("run").alias("strategy"))


# ---------------------------------------------------------------- report texts

RULE = "=" * 70
MEANS = "SELECT model, strategy, " + ", ".join(f"avg({m}) AS {m}" for m in MEASURES) + " FROM f GROUP BY model, strategy"


def fold_reports(spark, folder):
    """Aggregated fold reports, one per model and return flag.

    Flag A has the multiclass layout, N the binary one, R the binary layout in a multiclass folder;
    the last model's reports lack the final metric.
    """
    means = rows(spark, folder, FOLDS).groupBy("model", "strategy").agg(*[F.avg(m).alias(m) for m in MEASURES])
    is_multi = F.col("strategy") == "A"

    def line(name, column):
        return F.concat(F.lit(f"{name}: "), F.col(column).cast("string"))

    multi = [line("roc_auc_macro", "roc_auc"), F.lit("roc_auc_weighted: 0.5"), F.lit("roc_auc_micro: 0.5"), line("pr_auc_macro", "pr_auc"), F.lit("pr_auc: 0.25"), F.lit("roc_auc: 0.75")]
    last = F.when(F.col("model") != "model_8", line("pr_auc", "pr_auc"))
    ending = F.when(is_multi, F.concat_ws("\n", *multi)).otherwise(F.concat_ws("\n", line("roc_auc", "roc_auc"), last))
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("MODEL: "), "model"),
        F.lit(RULE),
        F.lit("Fold 1\n VALIDATION METRICS:\n   accuracy: 0.1\n   pr_auc: 0.2\n"),
        F.lit(reports.AGGREGATE_HEADING),
        F.lit(RULE),
        line("accuracy", "accuracy"),
        line("precision", "prec"),
        line("recall", "recall"),
        line("f1", "f1"),
        ending,
    )
    run = F.concat(F.lit("20250101_000000_src_default_"), F.when(F.col("strategy") == "N", "binary").otherwise("multiclass"), F.lit("_"), F.expr("CASE strategy WHEN 'A' THEN 'smoteenn' WHEN 'N' THEN 'randomundersampler' ELSE 'none' END"))
    path = F.concat(F.lit("/results/"), F.when(F.col("strategy") == "N", "binary").otherwise("multiclass"), F.lit("/"), run, F.lit("/"), "model", F.lit("/5fold_on_80_results.txt"))
    return means.select(path.alias("file_path"), run.alias("run"), "model", content.alias("content"))


PARSED = """SELECT '20250101_000000_src_default_' || CASE strategy WHEN 'N' THEN 'binary' ELSE 'multiclass' END || '_' ||
CASE strategy WHEN 'A' THEN 'smoteenn' WHEN 'N' THEN 'randomundersampler' ELSE 'none' END AS run, model,
CASE strategy WHEN 'A' THEN 'smoteenn' WHEN 'N' THEN 'rundersampler' ELSE 'none' END AS strategy,
CASE strategy WHEN 'A' THEN 'multiclass' ELSE 'binary' END AS task, round(accuracy, 6) AS accuracy, round(prec, 6) AS precision, round(recall, 6) AS recall,
round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc, CASE WHEN model = 'model_8' AND strategy <> 'A' THEN NULL ELSE round(pr_auc, 6) END AS pr_auc,
NOT (model = 'model_8' AND strategy <> 'A') AS parsed FROM means"""


@query("parse_fold_report", with_inputs("SELECT * FROM parsed", f=FOLDS, means=MEANS, parsed=PARSED))
def parse_fold_report(spark, folder):
    return rounded(reports.parse_fold_report(fold_reports(spark, folder)).drop("file_path"))


@query("rejected_reports", with_inputs("SELECT run, model FROM parsed WHERE NOT parsed", f=FOLDS, means=MEANS, parsed=PARSED))
def rejected_reports(spark, folder):
    parsed = reports.parse_fold_report(fold_reports(spark, folder))
    return reports.rejected_reports(parsed).select(
        F.element_at(F.split("file_path", "/"), -3).alias("run"), F.element_at(F.split("file_path", "/"), -2).alias("model")
    )


@query("read_reports", with_inputs("SELECT run, model, accuracy, f1 FROM parsed", f=FOLDS, means=MEANS, parsed=PARSED))
def read_reports(spark, folder):
    path = new_path(spark, "reports")
    fold_reports(spark, folder).select("run", "model", "content").write.partitionBy("run", "model").text(path)
    parsed = reports.parse_fold_report(readers.read_reports(spark, path))
    return rounded(parsed.select("run", "model", "accuracy", "f1"))


FOLD_SIZES = "SELECT 'model_' || CAST(l_suppkey % 9 AS STRING) AS model, l_returnflag AS run, l_linenumber AS fold, count(*) AS n FROM {lineitem} GROUP BY l_suppkey % 9, l_returnflag, l_linenumber"


def holdout_reports(spark, folder):
    """Holdout reports per run and model; flag A has the old layout, the others the new one."""
    sizes = rows(spark, folder, FOLD_SIZES)
    params = F.format_string(
        "{'max_depth': %d, 'n_estimators': %d, 'criterion': 'gini', 'bootstrap': False, 'hidden_layer_sizes': (100, 50)}", "fold", "n"
    )
    score = (F.col("n") / 10000.0).cast("string")
    old = F.concat_ws("\n", F.format_string("Fold %d:", "fold"), F.concat(F.lit("  Best Parameters: "), params), F.lit("  Holdout Metrics:\n    Accuracy: 0.9"), F.concat(F.lit("    PR-AUC: "), score), F.lit(""))
    new = F.concat_ws(
        "\n",
        F.format_string("FOLD %d", "fold"),
        F.lit(RULE),
        F.concat(F.lit("Best Parameters: "), params),
        F.lit("BALANCING STRATEGY: NONE"),
        F.concat(F.lit("    PR-AUC: "), score),
        F.lit("BALANCING STRATEGY: SMOTEENN\n    PR-AUC: 0.5\n"),
    )
    section = F.struct("fold", F.when(F.col("run") == "A", old).otherwise(new).alias("text"))
    # folds per report are few; each report is one small text
    grouped = sizes.groupBy("run", "model").agg(F.sort_array(F.collect_list(section)).alias("s"))
    tail = F.lit("BEST PERFORMING MODEL ON HOLDOUT SET:\nFold 3 (PR-AUC: 0.1889)\nParameters: {'max_depth': 5}")
    content = F.concat_ws("\n", F.lit("Holdout Evaluation Results"), F.array_join(F.transform("s", lambda x: x["text"]), "\n"), tail)
    return grouped.select(F.concat_ws("/", F.lit("results"), "run", "model").alias("file_path"), "run", "model", content.alias("content"))


@query(
    "parse_params",
    with_inputs(
        """SELECT run, model, fold, round(n / 10000, 6) AS pr_auc, CAST(fold AS VARCHAR) AS max_depth, CAST(n AS VARCHAR) AS n_estimators,
        'gini' AS criterion, 'False' AS bootstrap, '(100, 50)' AS sizes FROM s""",
        s=FOLD_SIZES,
    ),
)
def parse_params(spark, folder):
    parsed = reports.parse_params(holdout_reports(spark, folder))
    names = {"max_depth": "max_depth", "n_estimators": "n_estimators", "criterion": "criterion", "bootstrap": "bootstrap", "hidden_layer_sizes": "sizes"}
    return rounded(parsed.select("run", "model", "fold", "pr_auc", *[F.col("params")[p].alias(c) for p, c in names.items()]))


@query(
    "params_by_model_experiment",
    with_inputs(
        """SELECT run, model, fold, round(n / 10000, 6) AS pr_auc, position::INT AS position, CAST(n AS VARCHAR) AS n_estimators FROM
        (SELECT *, row_number() OVER (PARTITION BY model, run ORDER BY fold) AS position FROM s) WHERE position <= 5""",
        s=FOLD_SIZES,
    ),
)
def params_by_model_experiment(spark, folder):
    table_ = leaderboards.params_by_model_experiment(reports.parse_params(holdout_reports(spark, folder)))
    return rounded(table_.select("run", "model", "fold", "pr_auc", "position", F.col("params")["n_estimators"].alias("n_estimators")))


KNOWN_MODELS = [f"model_{i}" for i in range(6)]


@query("pending_runs", with_inputs("SELECT DISTINCT run, model FROM s WHERE run = 'A' AND model < 'model_6'", s=FOLD_SIZES))
def pending_runs(spark, folder):
    return reports.pending_runs(holdout_reports(spark, folder), KNOWN_MODELS)


@query(
    "parse_importances",
    with_inputs(
        """SELECT run, model, row_number() OVER (PARTITION BY run, model ORDER BY s.fold)::INT AS fold, 'max_depth' AS param, n + 0.5::DOUBLE AS value FROM s
        UNION ALL SELECT run, model, row_number() OVER (PARTITION BY run, model ORDER BY s.fold)::INT, 'criterion', s.fold + 0.25::DOUBLE FROM s""",
        s=FOLD_SIZES,
    ),
)
def parse_importances(spark, folder):
    block = F.concat(
        F.format_string("FOLD %d (loop externo):\n", "fold"),
        F.lit(reports.IMPORTANCE_HEADING),
        F.format_string("\n  max_depth: %d.5\n  criterion: %d.25\n...\n", "n", "fold"),
    )
    grouped = rows(spark, folder, FOLD_SIZES).groupBy("run", "model").agg(F.sort_array(F.collect_list(F.struct("fold", block.alias("text")))).alias("s"))
    texts = grouped.select("run", "model", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("content"))
    return reports.parse_importances(texts)


@query(
    "compile_fold_reports",
    with_inputs(
        """SELECT task, model, strategy, round(pr_auc, 6) AS pr_auc, row_number() OVER (PARTITION BY task, model ORDER BY pr_auc DESC, strategy)::INT AS rank
        FROM parsed WHERE parsed""",
        f=FOLDS,
        means=MEANS,
        parsed=PARSED,
    ),
)
def compile_fold_reports(spark, folder):
    top = compile_folds(fold_reports(spark, folder)).top
    return rounded(top.select("task", "model", "strategy", "pr_auc", "rank"))
