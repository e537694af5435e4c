"""ROC and PR curve points, grids and averaged curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.operators.metrics import (
    collapse_scores,
    cumulative_confusion,
    one_vs_rest_scores,
    ovo_scores,
    positive_score,
    ranking_metrics,
)
from labelweave.operators.ordering import running_totals
from labelweave.runtime import stage

GRID = 1000


def _with_rates(thresholds: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds fpr, tpr / recall and precision; class totals come from one row per group."""
    totals = thresholds.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    joined = thresholds.join(stage(totals, "totals"), list(groups))
    return joined.withColumns(
        {
            "ord": F.col("tp") + F.col("fp"),
            "fpr": F.try_divide("fp", "n_neg"),
            "tpr": F.try_divide("tp", "n_pos"),
            "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")),
        }
    )


def _start(points: DataFrame, groups: Sequence[str], values: dict[str, float]) -> DataFrame:
    first = points.select(*groups).distinct()
    return first.withColumns({c: F.lit(v) for c, v in values.items()})


def curve_points(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``(groups..., ord, threshold, fpr, tpr, precision)`` from the curve's start onward.

    ``ord`` counts the examples at or above the threshold; the start is ``ord`` 0 with precision 1.
    """
    rated = _with_rates(stage(cumulative_confusion(scores, groups), "curve"), groups).select(
        *groups, "ord", F.col("score").alias("threshold"), "fpr", "tpr", "precision"
    )
    start = _start(rated, groups, {"threshold": float("inf"), "fpr": 0.0, "tpr": 0.0, "precision": 1.0})
    return rated.unionByName(start.withColumn("ord", F.lit(0).cast("bigint")))


def roc_points(df: DataFrame, groups: Sequence[str], drop_intermediate: bool = True) -> DataFrame:
    """ROC points per group; with ``drop_intermediate`` collinear inner points are left out."""
    scores = collapse_scores(df, groups, F.col("y_true") == 1, positive_score("proba"))
    if drop_intermediate:
        return _roc_corners(scores, groups)
    return curve_points(scores, groups).select(*groups, "threshold", "fpr", "tpr")


def _roc_corners(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Points whose step differs from the following step, plus both ends of the curve."""
    numbered = stage(
        running_totals(
            scores,
            groups,
            [F.col("score").desc()],
            {"tp": F.col("pos"), "fp": F.col("neg"), "position": F.lit(1).cast("bigint")},
        ),
        "numbered",
    )
    following = numbered.select(
        *groups, (F.col("position") - 1).alias("position"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg")
    )
    rated = _with_rates(numbered, groups).join(following, [*groups, "position"], "left")
    inner = (
        (F.col("position") > 1)
        & F.col("next_pos").isNotNull()
        & (F.col("next_pos") == F.col("pos"))
        & (F.col("next_neg") == F.col("neg"))
    )
    points = rated.filter(~inner).select(*groups, F.col("score").alias("threshold"), "fpr", "tpr")
    return points.unionByName(
        _start(points, groups, {"threshold": float("inf"), "fpr": 0.0, "tpr": 0.0})
    )


def pr_points(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Precision and recall at every threshold plus the end point (recall 0, precision 1)."""
    scores = collapse_scores(df, groups, F.col("y_true") == 1, positive_score("proba"))
    points = curve_points(scores, groups)
    return points.select(*groups, "threshold", "precision", F.col("tpr").alias("recall"))


def curve_on_grid(
    points: DataFrame, groups: Sequence[str], x: str, y: str, order: str = "ord", n: int = GRID
) -> DataFrame:
    """Linear interpolation of ``y`` at ``n`` equally spaced ``x`` in [0, 1]: ``(groups..., g, x, y)``.

    Points are first reduced to the few that matter per grid cell, combined per task; the windows
    then see at most ``n`` rows per group however many points a curve has.  Of several points with
    the same ``x`` the last one holds, as in a right-continuous step.
    """
    groups = list(groups)
    step = 1.0 / (n - 1)

    def grid_x(g):
        return F.when(g >= n - 1, F.lit(1.0)).otherwise(g.cast("double") * F.lit(step))

    px = F.col(x)
    guess = F.floor(px * (n - 1)).cast("int")
    cell = (
        F.when((guess < n - 1) & (grid_x(guess + 1) <= px), guess + 1)
        .when((guess > 0) & (grid_x(guess) > px), guess - 1)
        .otherwise(guess)
    )
    point = F.struct(px.alias("x"), F.col(order).alias("o"), F.col(y).alias("y"))
    cells = (
        points.withColumn("g", cell)
        .withColumn("at_node", px == grid_x(F.col("g")))
        .groupBy(*groups, "g")
        .agg(
            F.max(F.when(F.col("at_node"), point)).alias("node"),
            F.min(F.when(~F.col("at_node"), point)).alias("inside"),
            F.min(point).alias("first"),
            F.max(point).alias("last"),
        )
    )
    # every group has a point in some cell; the grid is attached per group, n rows each
    grid = cells.select(*groups).distinct().select(*groups, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("g"))
    full = grid.join(cells, [*groups, "g"], "left")
    # both look-ups are running frames; a frame up to the end would be quadratic in the grid
    before = Window.partitionBy(*groups).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*groups).orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = full.select(
        *groups,
        "g",
        grid_x(F.col("g")).alias("x"),
        F.coalesce("node", F.last("last", ignorenulls=True).over(before)).alias("lo"),
        F.coalesce("inside", F.last("first", ignorenulls=True).over(after)).alias("hi"),
    )
    slope = F.try_divide(F.col("hi.y") - F.col("lo.y"), F.col("hi.x") - F.col("lo.x"))
    value = (
        F.when(F.col("lo").isNull(), F.col("hi.y"))
        .when(F.col("hi").isNull() | (F.col("lo.x") == F.col("x")), F.col("lo.y"))
        .otherwise(F.col("lo.y") + slope * (F.col("x") - F.col("lo.x")))
    )
    return ends.select(*groups, "g", "x", value.alias("y"))


def grid_area(curve: DataFrame, groups: Sequence[str], y: str = "y", n: int = GRID) -> DataFrame:
    """Trapezoid area of curves on the grid."""
    weight = F.when(F.col("g").isin(0, n - 1), 0.5).otherwise(1.0)
    return curve.groupBy(*groups).agg((F.sum(weight * F.col(y)) / (n - 1)).alias("auc"))


def _class_grids(df: DataFrame, groups: Sequence[str], x: str, y: str, n: int) -> DataFrame:
    keys = [*groups, "class"]
    points = curve_points(one_vs_rest_scores(df, groups), keys)
    return curve_on_grid(points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, y, n=n)


def macro_average_roc(df: DataFrame, groups: Sequence[str], n: int = GRID) -> DataFrame:
    """Mean one-vs-rest TPR on the FPR grid: ``(groups..., g, fpr, tpr)``."""
    curve = _class_grids(df, groups, "fpr", "tpr", n)
    return curve.groupBy(*groups, "g", F.col("x").alias("fpr")).agg(F.avg("y").alias("tpr"))


def macro_average_roc_auc(df: DataFrame, groups: Sequence[str], n: int = GRID) -> DataFrame:
    return grid_area(macro_average_roc(df, groups, n), groups, "tpr", n)


def macro_average_pr(df: DataFrame, groups: Sequence[str], n: int = GRID) -> DataFrame:
    """Mean one-vs-rest precision on the recall grid: ``(groups..., g, recall, precision)``."""
    curve = _class_grids(df, groups, "tpr", "precision", n)
    return curve.groupBy(*groups, "g", F.col("x").alias("recall")).agg(F.avg("y").alias("precision"))


def _pooled(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    scores = one_vs_rest_scores(df, groups)
    return scores.groupBy(*groups, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def micro_average_roc(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """ROC points of all one-vs-rest decisions pooled."""
    return curve_points(_pooled(df, groups), groups).select(*groups, "threshold", "fpr", "tpr")


def micro_average_pr(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """PR points of all one-vs-rest decisions pooled."""
    points = curve_points(_pooled(df, groups), groups)
    return points.select(*groups, "threshold", F.col("tpr").alias("recall"), "precision")


def average_curve_areas(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean of the class areas and area of the pooled curve, for ROC and (trapezoid) PR."""
    keys = [*groups, "class"]
    scores = one_vs_rest_scores(df, groups)
    pooled = scores.groupBy(*groups, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = scores.unionByName(pooled.withColumn("class", F.lit(-1)))
    ranked = ranking_metrics(cumulative_confusion(both, keys), keys)
    single = F.col("class") >= 0
    return ranked.groupBy(*groups).agg(
        F.avg(F.when(single, F.col("roc_auc"))).alias("roc_macro"),
        F.max(F.when(~single, F.col("roc_auc"))).alias("roc_micro"),
        F.avg(F.when(single, F.col("pr_auc_trapezoid"))).alias("pr_macro"),
        F.max(F.when(~single, F.col("pr_auc_trapezoid"))).alias("pr_micro"),
    )


def ovo_curves(df: DataFrame, groups: Sequence[str], n: int = GRID) -> DataFrame:
    """Mean TPR of both directions of every class pair on the FPR grid."""
    pair = [*groups, "class_a", "class_b"]
    keys = [*pair, "direction"]
    points = curve_points(ovo_scores(df, groups), keys)
    curve = curve_on_grid(points.filter("fpr IS NOT NULL AND tpr IS NOT NULL"), keys, "fpr", "tpr", n=n)
    return curve.groupBy(*pair, "g", F.col("x").alias("fpr")).agg(F.avg("y").alias("tpr"))


def ovo_auc(df: DataFrame, groups: Sequence[str], n: int = GRID) -> DataFrame:
    """Grid area of every class pair: ``(groups..., class_a, class_b, auc)``."""
    return grid_area(ovo_curves(df, groups, n), [*groups, "class_a", "class_b"], "tpr", n)


def ovo_macro_auc(df: DataFrame, groups: Sequence[str], n: int = GRID) -> DataFrame:
    """Mean of the pair areas."""
    return ovo_auc(df, groups, n).groupBy(*groups).agg(F.avg("auc").alias("macro_auc"))
