"""Metric and curve queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import BINARY, FOLDS, PREDICTIONS, binary_predictions, predictions, query, rounded, rows, with_inputs
from labelweave.operators import curves, metrics

#: one-vs-rest rows, collapsed thresholds and areas as SQL, for the checks
OVR = """SELECT model, k AS class, (y_true = k)::INT AS pos, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS score
FROM p, (SELECT unnest([0, 1, 2]) AS k)"""


def thresholds_sql(source: str, keys: str) -> str:
    return f"""SELECT *, sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY {keys} ORDER BY score DESC) AS fp,
sum(pos) OVER (PARTITION BY {keys}) AS n_pos, sum(neg) OVER (PARTITION BY {keys}) AS n_neg
FROM (SELECT {keys}, score, sum(pos)::BIGINT AS pos, (count(*) - sum(pos))::BIGINT AS neg FROM {source} GROUP BY {keys}, score)"""


def areas_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc,
sum(pos * tp / (tp + fp)) / sum(pos) AS average_precision,
sum(pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN 1 ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2) / sum(pos) AS pr_auc_trapezoid
FROM {source} GROUP BY {keys}"""


BIN_INPUTS = {
    "p": BINARY,
    "s": "SELECT model, y_true AS pos, score FROM p",
    "t": thresholds_sql("s", "model"),
    "areas": areas_sql("t", "model"),
}
OVR_INPUTS = {"p": PREDICTIONS, "s": OVR, "t": thresholds_sql("s", "model, class"), "areas": areas_sql("t", "model, class")}
MICRO_INPUTS = {
    **OVR_INPUTS,
    "sm": "SELECT model, pos, score FROM s",
    "tm": thresholds_sql("sm", "model"),
    "micro": areas_sql("tm", "model"),
}


@query("class_prob_column", with_inputs("SELECT model, y_true, round(score, 6) AS score FROM p", p=BINARY))
def class_prob_column(spark, folder):
    scored = metrics.class_prob_column(binary_predictions(spark, folder))
    return rounded(scored.select("model", "y_true", "score"))


@query("detect_task_type", with_inputs("SELECT model, count(DISTINCT y_true) AS n_labels, 3 AS width, 'multiclass' AS task FROM p GROUP BY model", p=PREDICTIONS))
def detect_task_type(spark, folder):
    return metrics.detect_task_type(predictions(spark, folder), ["model"])


@query(
    "confusion_matrix",
    with_inputs(
        """SELECT m.model, a.k AS actual, b.k AS predicted, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT model FROM p) m,
        (SELECT unnest([0, 1, 2]) AS k) a, (SELECT unnest([0, 1, 2]) AS k) b
        LEFT JOIN (SELECT model, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL) c ON c.model = m.model AND c.y_true = a.k AND c.y_pred = b.k""",
        p=PREDICTIONS,
    ),
)
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(predictions(spark, folder), ["model"])


MACRO = """SELECT model, k, count(*) FILTER (y_true = k AND y_pred = k) AS tp, count(*) FILTER (y_true = k) AS nt, count(*) FILTER (y_pred = k) AS np
FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY model, k"""


@query(
    "classification_metrics",
    with_inputs(
        """SELECT model, round(sum(tp) / sum(nt), 6) AS accuracy, round(avg(coalesce(tp / nullif(np, 0), 0)), 6) AS precision,
        round(avg(coalesce(tp / nullif(nt, 0), 0)), 6) AS recall, round(avg(coalesce(2 * tp / nullif(np + nt, 0), 0)), 6) AS f1 FROM m GROUP BY model""",
        p=PREDICTIONS,
        m=MACRO,
    ),
)
def classification_metrics(spark, folder):
    return rounded(metrics.classification_metrics(predictions(spark, folder), ["model"], "macro"))


@query(
    "classification_metrics_binary",
    with_inputs(
        """SELECT model, round(count(*) FILTER (y_true = y_pred) / count(*), 6) AS accuracy,
        round(count(*) FILTER (y_true = 1 AND y_pred = 1) / count(*) FILTER (y_pred = 1), 6) AS precision,
        round(count(*) FILTER (y_true = 1 AND y_pred = 1) / count(*) FILTER (y_true = 1), 6) AS recall,
        round(2 * count(*) FILTER (y_true = 1 AND y_pred = 1) / (count(*) FILTER (y_true = 1) + count(*) FILTER (y_pred = 1)), 6) AS f1 FROM p GROUP BY model""",
        p=BINARY,
    ),
)
def classification_metrics_binary(spark, folder):
    return rounded(metrics.classification_metrics(binary_predictions(spark, folder), ["model"]))


@query("cumulative_confusion", with_inputs("SELECT model, score, pos, neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM t", **BIN_INPUTS))
def cumulative_confusion(spark, folder):
    scored = rows(spark, folder, BINARY)
    collapsed = metrics.collapse_scores(scored, ["model"], F.col("y_true") == 1, F.col("score"))
    return metrics.cumulative_confusion(collapsed, ["model"])


@query("roc_auc", with_inputs("SELECT model, round(roc_auc, 6) AS roc_auc FROM areas", **BIN_INPUTS))
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(binary_predictions(spark, folder), ["model"]))


@query("average_precision", with_inputs("SELECT model, round(average_precision, 6) AS average_precision FROM areas", **BIN_INPUTS))
def average_precision(spark, folder):
    return rounded(metrics.average_precision(binary_predictions(spark, folder), ["model"]))


@query("pr_auc_trapezoid", with_inputs("SELECT model, round(pr_auc_trapezoid, 6) AS pr_auc_trapezoid FROM areas", **BIN_INPUTS))
def pr_auc_trapezoid(spark, folder):
    return rounded(metrics.pr_auc_trapezoid(binary_predictions(spark, folder), ["model"]))


@query(
    "per_class_auc",
    with_inputs(
        "SELECT model, class, n_pos, n_neg, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(pr_auc_trapezoid, 6) AS pr_auc_trapezoid FROM areas",
        **OVR_INPUTS,
    ),
)
def per_class_auc(spark, folder):
    return rounded(metrics.per_class_auc(predictions(spark, folder), ["model"]))


AVERAGED = """SELECT a.model, avg(a.roc_auc) AS roc_auc_macro, sum(a.n_pos * a.roc_auc) / sum(a.n_pos) AS roc_auc_weighted, any_value(m.roc_auc) AS roc_auc_micro,
avg(a.average_precision) AS pr_auc_macro, sum(a.n_pos * a.average_precision) / sum(a.n_pos) AS pr_auc_weighted, any_value(m.average_precision) AS pr_auc_micro
FROM areas a JOIN micro m ON a.model = m.model GROUP BY a.model"""
AVERAGED_ROUNDED = "SELECT model, " + ", ".join(
    f"round({m}_{w}, 6) AS {m}_{w}" for m in ("roc_auc", "pr_auc") for w in ("macro", "weighted", "micro")
) + " FROM averaged"


@query("averaged_auc", with_inputs(AVERAGED_ROUNDED, **MICRO_INPUTS, averaged=AVERAGED))
def averaged_auc(spark, folder):
    return rounded(metrics.averaged_auc(predictions(spark, folder), ["model"]))


@query(
    "model_auc_comparison",
    with_inputs(
        "SELECT 'Model ' || model[7:] AS display_name, round(roc_auc_weighted, 6) AS roc_auc, round(pr_auc_weighted, 6) AS pr_auc FROM averaged",
        **MICRO_INPUTS,
        averaged=AVERAGED,
    ),
)
def model_auc_comparison(spark, folder):
    return rounded(metrics.model_auc_comparison(predictions(spark, folder)))


OVO = """SELECT model, least(y_true, o) AS class_a, greatest(y_true, o) AS class_b, d AS direction,
(y_true = CASE d WHEN 'a' THEN least(y_true, o) ELSE greatest(y_true, o) END)::INT AS pos,
CASE (CASE d WHEN 'a' THEN least(y_true, o) ELSE greatest(y_true, o) END) WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS score
FROM p, (SELECT unnest([0, 1, 2]) AS o), (SELECT unnest(['a', 'b']) AS d) WHERE o <> y_true"""
OVO_KEYS = "model, class_a, class_b, direction"
OVO_INPUTS = {"po": PREDICTIONS, "so": OVO.replace("FROM p,", "FROM po,"), "to_": thresholds_sql("so", OVO_KEYS), "ao": areas_sql("to_", OVO_KEYS)}


@query(
    "ovo_weighted_auc",
    with_inputs(
        """SELECT a.model, round(o.ovo, 6) AS ovo_weighted, round(a.roc_auc_weighted, 6) AS ovr_weighted FROM averaged a JOIN
        (SELECT model, sum(n * auc) / sum(n) AS ovo FROM (SELECT model, class_a, class_b, avg(roc_auc) AS auc, max(n_pos + n_neg) AS n FROM ao GROUP BY ALL) GROUP BY model) o
        ON a.model = o.model""",
        **MICRO_INPUTS,
        averaged=AVERAGED,
        **OVO_INPUTS,
    ),
)
def ovo_weighted_auc(spark, folder):
    return rounded(metrics.ovo_weighted_auc(predictions(spark, folder), ["model"]))


@query("random_baseline", with_inputs("SELECT model, round(avg(y_true), 6) AS baseline FROM p GROUP BY model", p=BINARY))
def random_baseline(spark, folder):
    return rounded(metrics.random_baseline(binary_predictions(spark, folder), ["model"]))


@query(
    "metrics_table_from_predictions",
    with_inputs(
        """SELECT 'r' AS run, p.model, round(count(*) FILTER (y_true = y_pred) / count(*), 6) AS accuracy,
        round(count(*) FILTER (y_true = 1 AND y_pred = 1) / count(*) FILTER (y_pred = 1), 6) AS precision,
        round(count(*) FILTER (y_true = 1 AND y_pred = 1) / count(*) FILTER (y_true = 1), 6) AS recall,
        round(2 * count(*) FILTER (y_true = 1 AND y_pred = 1) / (count(*) FILTER (y_true = 1) + count(*) FILTER (y_pred = 1)), 6) AS f1,
        round(any_value(a.roc_auc), 6) AS roc_auc, round(any_value(a.average_precision), 6) AS pr_auc FROM p JOIN areas a ON p.model = a.model GROUP BY p.model""",
        **BIN_INPUTS,
    ),
)
def metrics_table_from_predictions(spark, folder):
    pooled = binary_predictions(spark, folder).withColumn("run", F.lit("r"))
    return rounded(metrics.metrics_table_from_predictions(pooled))


@query(
    "fold_summary",
    with_inputs("SELECT model, round(avg(pr_auc), 6) AS mean, round(stddev_pop(pr_auc), 6) AS std FROM f GROUP BY model", f=FOLDS),
)
def fold_summary(spark, folder):
    return rounded(metrics.fold_summary(rows(spark, folder, FOLDS), ["model"], "pr_auc"))


# ---------------------------------------------------------------- curves


def nudged(column):
    """Six digits; the nudge keeps ratios off the half-way values the two engines round apart."""
    return F.round(F.col(column) + 1e-9, 6).alias(column)


ROC_CORNERS = """SELECT model, score AS threshold, round(fp / n_neg + 1e-9, 6) AS fpr, round(tp / n_pos + 1e-9, 6) AS tpr FROM
(SELECT *, row_number() OVER w AS i, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM t WINDOW w AS (PARTITION BY model ORDER BY score DESC))
WHERE i = 1 OR np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT DISTINCT model, 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM t"""


@query("roc_points", with_inputs("SELECT model, round(threshold, 6) AS threshold, fpr, tpr FROM c", **BIN_INPUTS, c=ROC_CORNERS))
def roc_points(spark, folder):
    points = curves.roc_points(binary_predictions(spark, folder), ["model"])
    finite = F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(F.round("threshold", 6))
    return points.select("model", finite.alias("threshold"), nudged("fpr"), nudged("tpr"))


@query(
    "pr_points",
    with_inputs(
        """SELECT model, round(tp / (tp + fp) + 1e-9, 6) AS precision, round(tp / n_pos + 1e-9, 6) AS recall FROM t
        UNION ALL SELECT DISTINCT model, 1.0::DOUBLE, 0.0::DOUBLE FROM t""",
        **BIN_INPUTS,
    ),
)
def pr_points(spark, folder):
    return curves.pr_points(binary_predictions(spark, folder), ["model"]).select("model", nudged("precision"), nudged("recall"))


def grid_sql(points: str, keys: str) -> str:
    """Interpolation at the grid nodes: the last point at or before a node and the first one after it."""
    on = " AND ".join(f"g.{k} = q.{k}" for k in keys.split(", "))
    cols = ", ".join(f"g.{k}" for k in keys.split(", "))
    return f"""SELECT {cols}, g.g, g.gx, CASE WHEN b.x IS NULL OR a.x = g.gx THEN a.y ELSE a.y + (b.y - a.y) / (b.x - a.x) * (g.gx - a.x) END AS y FROM
(SELECT *, CASE WHEN g = 999 THEN 1.0::DOUBLE ELSE g * (1.0::DOUBLE / 999) END AS gx FROM (SELECT DISTINCT {keys} FROM {points}), (SELECT unnest(range(1000))::INT AS g)) g
ASOF LEFT JOIN (SELECT {keys}, x, arg_max(y, o) AS y FROM {points} GROUP BY {keys}, x) a ON {on.replace('q.', 'a.')} AND g.gx >= a.x
ASOF LEFT JOIN (SELECT {keys}, x, arg_min(y, o) AS y FROM {points} GROUP BY {keys}, x) b ON {on.replace('q.', 'b.')} AND g.gx < b.x"""


def points_sql(source: str, keys: str, x: str, y: str, start: float) -> str:
    return f"""SELECT {keys}, {x} AS x, {y} AS y, tp + fp AS o FROM {source}
UNION ALL SELECT DISTINCT {keys}, 0.0::DOUBLE, {start}::DOUBLE, 0 FROM {source}"""


ROC_XY = ("fp / n_neg", "tp / n_pos", 0.0)
PR_XY = ("tp / n_pos", "tp / (tp + fp)", 1.0)


@query(
    "curve_on_grid",
    with_inputs("SELECT model, g, round(gx, 6) AS x, round(y, 6) AS y FROM grid", **BIN_INPUTS, pts=points_sql("t", "model", *ROC_XY), grid=grid_sql("pts", "model")),
)
def curve_on_grid(spark, folder):
    scored = rows(spark, folder, BINARY)
    collapsed = metrics.collapse_scores(scored, ["model"], F.col("y_true") == 1, F.col("score"))
    return rounded(curves.curve_on_grid(curves.curve_points(collapsed, ["model"]), ["model"], "fpr", "tpr"))


@query(
    "macro_average_roc",
    with_inputs(
        "SELECT model, g, round(gx, 6) AS fpr, round(avg(y), 6) AS tpr FROM grid GROUP BY model, g, gx",
        **OVR_INPUTS,
        pts=points_sql("t", "model, class", *ROC_XY),
        grid=grid_sql("pts", "model, class"),
    ),
)
def macro_average_roc(spark, folder):
    return rounded(curves.macro_average_roc(predictions(spark, folder), ["model"]))


@query(
    "macro_average_roc_auc",
    with_inputs(
        "SELECT model, round(sum(CASE WHEN g IN (0, 999) THEN 0.5 ELSE 1.0 END::DOUBLE * tpr) / 999, 6) AS auc FROM (SELECT model, g, avg(y) AS tpr FROM grid GROUP BY model, g) GROUP BY model",
        **OVR_INPUTS,
        pts=points_sql("t", "model, class", *ROC_XY),
        grid=grid_sql("pts", "model, class"),
    ),
)
def macro_average_roc_auc(spark, folder):
    return rounded(curves.macro_average_roc_auc(predictions(spark, folder), ["model"]))


@query(
    "macro_average_pr",
    with_inputs(
        "SELECT model, g, round(gx, 6) AS recall, round(avg(y), 6) AS precision FROM grid GROUP BY model, g, gx",
        **OVR_INPUTS,
        pts=points_sql("t", "model, class", *PR_XY),
        grid=grid_sql("pts", "model, class"),
    ),
)
def macro_average_pr(spark, folder):
    return rounded(curves.macro_average_pr(predictions(spark, folder), ["model"]))


@query(
    "micro_average_roc",
    with_inputs(
        """SELECT model, round(fp / n_neg + 1e-9, 6) AS fpr, round(tp / n_pos + 1e-9, 6) AS tpr FROM tm
        UNION ALL SELECT DISTINCT model, 0.0::DOUBLE, 0.0::DOUBLE FROM tm""",
        **MICRO_INPUTS,
    ),
)
def micro_average_roc(spark, folder):
    return curves.micro_average_roc(predictions(spark, folder), ["model"]).select("model", nudged("fpr"), nudged("tpr"))


@query(
    "micro_average_pr",
    with_inputs(
        """SELECT model, round(tp / n_pos + 1e-9, 6) AS recall, round(tp / (tp + fp) + 1e-9, 6) AS precision FROM tm
        UNION ALL SELECT DISTINCT model, 0.0::DOUBLE, 1.0::DOUBLE FROM tm""",
        **MICRO_INPUTS,
    ),
)
def micro_average_pr(spark, folder):
    return curves.micro_average_pr(predictions(spark, folder), ["model"]).select("model", nudged("recall"), nudged("precision"))


@query(
    "average_curve_areas",
    with_inputs(
        """SELECT a.model, round(avg(a.roc_auc), 6) AS roc_macro, round(any_value(m.roc_auc), 6) AS roc_micro,
        round(avg(a.pr_auc_trapezoid), 6) AS pr_macro, round(any_value(m.pr_auc_trapezoid), 6) AS pr_micro FROM areas a JOIN micro m ON a.model = m.model GROUP BY a.model""",
        **MICRO_INPUTS,
    ),
)
def average_curve_areas(spark, folder):
    return rounded(curves.average_curve_areas(predictions(spark, folder), ["model"]))


OVO_GRID = {
    **OVO_INPUTS,
    "pts": points_sql("to_", OVO_KEYS, *ROC_XY),
    "grid": grid_sql("pts", OVO_KEYS),
    "pair": "SELECT model, class_a, class_b, g, avg(y) AS tpr FROM grid GROUP BY ALL",
    "pair_auc": "SELECT model, class_a, class_b, sum(CASE WHEN g IN (0, 999) THEN 0.5 ELSE 1.0 END::DOUBLE * tpr) / 999 AS auc FROM pair GROUP BY ALL",
}


@query("ovo_auc", with_inputs("SELECT model, class_a, class_b, round(auc, 6) AS auc FROM pair_auc", **OVO_GRID))
def ovo_auc(spark, folder):
    return rounded(curves.ovo_auc(predictions(spark, folder), ["model"]))


@query("ovo_macro_auc", with_inputs("SELECT model, round(avg(auc), 6) AS macro_auc FROM pair_auc GROUP BY model", **OVO_GRID))
def ovo_macro_auc(spark, folder):
    return rounded(curves.ovo_macro_auc(predictions(spark, folder), ["model"]))
