"""Training, search and evaluation queries on the embedding matrix, with the operators' own numbers of trials, folds, strategies and families.

The training queries return the held-out rows with their prediction and class shares; the tree families are checked by SQL texts that
grow the same trees (:mod:`catalog.tree_sql`).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.balancing import matrix, unit_sql
from catalog.base import MATRIX, query, rounded, rows, table, with_inputs
from catalog.tree_sql import boosting_sql, looped_boosting_sql, tree_sql
from labelweave.learning import models, search, spaces
from labelweave.operators import clean, splits
from labelweave.runtime import stage

THREE = "SELECT CAST(vec_id AS STRING) AS key, embedding AS features, CASE WHEN label < 3 THEN 0 WHEN label < 6 THEN 1 ELSE 2 END AS label FROM {embeddings}"


def _split(df):
    split = stage(splits.stratified_holdout(df, "key", "label"), "split", rebalance=True)
    return split.filter("NOT is_test"), split.filter("is_test")


def _scored(df, model, params, n_classes=2):
    """Predictions of the test rows by a model fitted on the training rows; the first of the likeliest classes, to six places."""
    train, test = _split(df)
    out = models.predict(models.fit_model(model, train, params, n_classes), test)
    shares = [F.round(F.element_at("proba", c + 1), 6).alias(f"p{c}") for c in range(n_classes)]
    found = out.select("key", "y_true", *shares)
    columns = [f"p{c}" for c in range(n_classes)]
    likeliest = F.array_position(F.array(*columns), F.greatest(*columns)).cast("int") - 1
    return found.select("key", "y_true", likeliest.alias("y_pred"), *columns)


@query(
    "standardize",
    with_inputs(
        """SELECT key, position, round((x - avg(x) OVER (PARTITION BY position)) / stddev_pop(x) OVER (PARTITION BY position), 6) AS value
        FROM (SELECT key, generate_subscripts(features, 1)::INT - 1 AS position, unnest(features)::DOUBLE AS x FROM m)""",
        m=MATRIX,
    ),
)
def standardize(spark, folder):
    scaled = models.standardize(matrix(spark, folder))
    return rounded(scaled.select("key", F.posexplode("features").alias("position", "value")))


@query("train_decision_tree", tree_sql(MATRIX, depth=6, criterion="entropy", balanced=True))
def train_decision_tree(spark, folder):
    return _scored(matrix(spark, folder), "decision_tree", {"max_depth": "6", "class_weight": "balanced", "criterion": "entropy"})


@query("train_random_forest", tree_sql(MATRIX, depth=6, balanced=True, trees=20, subset=8))
def train_random_forest(spark, folder):
    return _scored(matrix(spark, folder), "random_forest", {"n_estimators": "20", "max_depth": "6", "class_weight": "balanced"})


@query("train_gbt", boosting_sql(MATRIX, rounds=5))
def train_gbt(spark, folder):
    return _scored(matrix(spark, folder), "gradient_boosting", {"n_estimators": "5"})


@query("train_gbt_multiclass", boosting_sql(THREE, 3))
def train_gbt_multiclass(spark, folder):
    return _scored(rows(spark, folder, THREE), "gradient_boosting", {"n_estimators": "3"}, 3)


@query("train_gbt_regularised", boosting_sql(MATRIX, rounds=4, depth=4, rate=0.3, l2=5.0, l1=0.5, gamma=0.2, hessian=3.0))
def train_gbt_regularised(spark, folder):
    params = {"n_estimators": "4", "max_depth": "4", "reg_lambda": "5", "reg_alpha": "0.5", "gamma": "0.2", "min_child_weight": "3", "max_bins": "255"}
    return _scored(matrix(spark, folder), "xgboost", params)


def _presets_sql() -> str:
    presets = {
        "histogram_gradient_boosting": looped_boosting_sql(MATRIX, 100, depth=5, rate=0.1, leaf=20),
        "xgboost": looped_boosting_sql(MATRIX, 100, depth=6, rate=0.3, l2=1.0, hessian=1.0),
        "catboost": looped_boosting_sql(MATRIX, 1000, depth=6, rate=0.03, l2=3.0),
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS model, * FROM ({sql})" for name, sql in presets.items())


@query("train_gbt_presets", _presets_sql())
def train_gbt_presets(spark, folder):
    """Each preset with its own defaults and all of its rounds; the draws of one family, which SQL has not, are off."""
    given = {
        "histogram_gradient_boosting": {},
        "catboost": {"bagging_temperature": "0", "random_strength": "0", "border_count": "255"},
        "xgboost": {"max_bins": "255"},
    }
    parts = [_scored(matrix(spark, folder), m, p).select(F.lit(m).alias("model"), "*") for m, p in given.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("train_mlp")
def train_mlp(spark, folder):
    return _scored(matrix(spark, folder), "multi_layer_perceptron", {"layer_0_size": "16"})


@query("train_svm")
def train_svm(spark, folder):
    return _scored(matrix(spark, folder), "svc", {"kernel": "rbf", "class_weight": "balanced"})


@query("predict", tree_sql(THREE, 3, depth=5))
def predict(spark, folder):
    return _scored(rows(spark, folder, THREE), "decision_tree", {"max_depth": "5"}, 3)


STUDIES = "SELECT o_custkey AS study, o_orderkey AS trial FROM {orders}"


def _u(name: str) -> str:
    return unit_sql(f"42|{name}", "study", "trial")


@query(
    "param_space",
    with_inputs(
        f"""SELECT study, trial, CAST(100 + floor({_u('n_estimators')} * 5) * 50 AS INT) AS n_estimators,
        round(0.01::DOUBLE + {_u('learning_rate')} * (0.3::DOUBLE - 0.01::DOUBLE), 6) AS learning_rate,
        (['None', 'sqrt', 'log2'])[floor({_u('max_features')} * 3)::INT + 1] AS max_features,
        (['linear', 'poly', 'rbf', 'sigmoid'])[floor({_u('kernel')} * 4)::INT + 1] AS kernel,
        round(exp(ln(0.1::DOUBLE) + {_u('C')} * (ln(100.0::DOUBLE) - ln(0.1::DOUBLE))), 6) AS c,
        CASE WHEN floor({_u('kernel')} * 4) = 2 THEN (['scale', 'auto'])[floor({_u('gamma')} * 2)::INT + 1] END AS gamma FROM s""",
        s=STUDIES,
    ),
)
def param_space(spark, folder):
    studies = rows(spark, folder, STUDIES)
    boosted = spaces.sample_trials(studies, "gradient_boosting").withColumnRenamed("params", "b")
    both = spaces.sample_trials(boosted, "svc")
    b, s = F.col("b"), F.col("params")
    return rounded(
        both.select(
            "study",
            "trial",
            b["n_estimators"].cast("int").alias("n_estimators"),
            b["learning_rate"].cast("double").alias("learning_rate"),
            b["max_features"].alias("max_features"),
            s["kernel"].alias("kernel"),
            s["C"].cast("double").alias("c"),
            s["gamma"].alias("gamma"),
        )
    )


@query("search_trials")
def search_trials(spark, folder):
    """All trials of the full space, on all inner folds, with balanced training folds."""
    trials = search.search_trials("decision_tree", matrix(spark, folder), strategy="randomundersampler")
    return rounded(trials.select("study", "trial", F.to_json("params").alias("params"), "score"))


@query("param_importance")
def param_importance(spark, folder):
    """Importance of drawn parameters for a score that every order gives its trial."""
    studies = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("trial"), (F.col("o_totalprice") / 500000).alias("noise")
    )
    drawn = spaces.sample_trials(studies, "decision_tree")
    score = F.col("params")["max_depth"].cast("double") / 32 + F.col("noise") * 0.1
    return rounded(search.param_importance(drawn.select("params", score.alias("score")), "decision_tree"))


@query("nested_cv")
def nested_cv(spark, folder):
    """Thirty trials on five inner folds of each of five outer ones."""
    scored, _ = search.nested_cv("decision_tree", matrix(spark, folder))
    return rounded(scored)


@query("holdout_grid")
def holdout_grid(spark, folder):
    """The trials of five folds with all four strategies."""
    trials = spaces.trial_table(spark, "grid", 5, "gradient_boosting", reduced=True)
    params = [(r.trial, dict(r.params)) for r in trials.orderBy("trial").collect()]
    scored, _ = search.holdout_grid("gradient_boosting", matrix(spark, folder), params)
    return rounded(scored)


@query("refit_best")
def refit_best(spark, folder):
    """The winner among the outer folds' best trials, fitted on the whole training part."""
    data = matrix(spark, folder)
    scored, bests = search.nested_cv("decision_tree", data, reduced=True)
    folds = scored.filter("split = 'test' AND metric = 'pr_auc'").select(F.lit("decision_tree").alias("model"), "fold", F.col("value").alias("pr_auc"))
    params = {r.fold: r.params for r in bests.select("fold", "params").collect()}
    out = search.refit_best("decision_tree", data, folds, params)
    return rounded(out.select("key", "y_true", "y_pred", F.element_at("proba", 2).alias("score")))


@query("evaluate_default")
def evaluate_default(spark, folder):
    """All families with their default parameters, on the holdout and on five folds."""
    scored, _ = search.evaluate_default(sorted(models.FAMILIES), matrix(spark, folder))
    return rounded(scored)


@query("evaluate_default_trees")
def evaluate_default_trees(spark, folder):
    """The same sweep for a tree and a forest alone, which the benchmark times."""
    scored, _ = search.evaluate_default(["decision_tree", "random_forest"], matrix(spark, folder))
    return rounded(scored)


@query("feature_group_cv")
def feature_group_cv(spark, folder):
    """All feature groups, plain and with balanced classes, on five folds."""
    given = {"decision_tree": {}, "random_forest": {}, "xgboost": {}}
    return rounded(search.feature_group_cv(given, matrix(spark, folder), sorted(clean.FEATURE_GROUPS)))


@query(
    "run_status",
    with_inputs(
        "SELECT model, status, jobs FROM (VALUES ('decision_tree', 'ok'), ('unheard_of', 'error')) t(model, status), (SELECT 1 + count(DISTINCT fold) AS jobs FROM f)",
        m=MATRIX,
        f="SELECT (row_number() OVER (ORDER BY md5('42|' || key), key) - 1) % 5 AS fold FROM m",
    ),
)
def run_status(spark, folder):
    _, status = search.evaluate_default({"decision_tree": {}, "unheard_of": {}}, matrix(spark, folder))
    return status.groupBy("model", "status").agg(F.count("*").alias("jobs"))
