"""Classification metrics for many runs, models and classes in one pass.

Predictions are rows ``(groups..., y_true INT, y_pred INT, proba ARRAY<DOUBLE>)``.  Scores are
first collapsed to one row per (group, score) with counts of positives and negatives, combined
per task before the shuffle; running totals then work for a group of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.operators.ordering import running_totals


def positive_score(proba: Column | str) -> Column:
    """Score of the positive class from a one- or two-column probability."""
    column = F.col(proba) if isinstance(proba, str) else proba
    return F.when(F.size(column) > 1, F.try_element_at(column, F.lit(2))).otherwise(
        F.try_element_at(column, F.lit(1))
    )


def class_prob_column(df: DataFrame, proba: str = "proba", name: str = "score") -> DataFrame:
    return df.withColumn(name, positive_score(proba))


def detect_task_type(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Binary or multiclass, from the labels seen and the width of the probabilities."""
    seen = df.groupBy(*groups, "y_true").agg(F.max(F.size("proba")).alias("width"))
    per_group = seen.groupBy(*groups).agg(
        F.count("y_true").alias("n_labels"), F.max("width").alias("width")
    )
    multi = (F.col("n_labels") > 2) | (F.col("width") > 2)
    return per_group.withColumn("task", F.when(multi, "multiclass").otherwise("binary"))


def confusion_counts(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    return df.groupBy(*groups, F.col("y_true").alias("actual"), F.col("y_pred").alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``(groups..., actual, predicted, n)`` with the zero cells."""
    counts = confusion_counts(df, groups)
    # the classes of a group come from its counted cells, at most classes x classes rows
    classes = counts.groupBy(*groups).agg(
        F.array_union(F.collect_set("actual"), F.collect_set("predicted")).alias("classes")
    )
    cells = classes.select(*groups, "classes", F.explode("classes").alias("actual")).select(
        *groups, "actual", F.explode("classes").alias("predicted")
    )
    joined = cells.join(counts, [*groups, "actual", "predicted"], "left")
    return joined.select(*groups, "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def classification_metrics(df: DataFrame, groups: Sequence[str], average: str = "binary") -> DataFrame:
    """Accuracy, precision, recall and F1 per group; 0 where a denominator is 0.

    ``binary`` scores class 1, ``macro`` averages over the classes seen as label or prediction.
    """
    counts = confusion_counts(df, groups)
    per_class = (
        counts.select(
            *groups,
            F.inline(
                F.array(
                    F.struct(
                        F.col("actual").alias("class"),
                        F.col("n").alias("n_true"),
                        F.lit(0).cast("bigint").alias("n_pred"),
                        F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"),
                    ),
                    F.struct(
                        F.col("predicted").alias("class"),
                        F.lit(0).cast("bigint").alias("n_true"),
                        F.col("n").alias("n_pred"),
                        F.lit(0).cast("bigint").alias("tp"),
                    ),
                )
            ),
        )
        .groupBy(*groups, "class")
        .agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp")])
    )
    zero = F.lit(0.0)
    scored = per_class.withColumns(
        {
            "p": F.coalesce(F.try_divide("tp", "n_pred"), zero),
            "r": F.coalesce(F.try_divide("tp", "n_true"), zero),
            "f": F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")), zero),
        }
    )

    def over_classes(column: str) -> Column:
        if average == "macro":
            return F.avg(column)
        return F.coalesce(F.max(F.when(F.col("class") == 1, F.col(column))), zero)

    return scored.groupBy(*groups).agg(
        F.try_divide(F.sum("tp"), F.sum("n_true")).alias("accuracy"),
        over_classes("p").alias("precision"),
        over_classes("r").alias("recall"),
        over_classes("f").alias("f1"),
    )


def collapse_scores(df: DataFrame, groups: Sequence[str], positive: Column, score: Column) -> DataFrame:
    """``(groups..., score, pos, neg)``: one row per distinct score.

    Examples without a score stay: they are one row, which ranks below every score.
    """
    return df.groupBy(*groups, score.alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def cumulative_confusion(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds ``tp`` and ``fp`` at each distinct threshold, highest score first; ties are one row."""
    return running_totals(scores, groups, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})


def ranking_metrics(thresholds: DataFrame, groups: Sequence[str]) -> DataFrame:
    """ROC-AUC, average precision and trapezoid PR-AUC from ``cumulative_confusion`` rows.

    The row before a threshold is known from the row itself (its totals minus its own counts), so
    no lag is needed.
    """
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    precision = tp / (tp + fp)
    before = F.coalesce(F.try_divide(tp - pos, tp - pos + fp - neg), F.lit(1.0))
    sums = thresholds.groupBy(*groups).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(neg * (tp - pos / 2)).alias("wins"),
        F.sum(pos * precision).alias("steps"),
        F.sum(pos * (precision + before) / 2).alias("trapezoids"),
    )
    return sums.select(
        *groups,
        "n_pos",
        "n_neg",
        F.try_divide(F.col("wins"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"),
        F.try_divide("steps", "n_pos").alias("average_precision"),
        F.try_divide("trapezoids", "n_pos").alias("pr_auc_trapezoid"),
    )


def binary_ranking(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Ranking metrics of the positive class per group."""
    scores = collapse_scores(df, groups, F.col("y_true") == 1, positive_score("proba"))
    return ranking_metrics(cumulative_confusion(scores, groups), groups)


def roc_auc(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Exact ROC-AUC with ties counted as half."""
    return binary_ranking(df, groups).select(*groups, "roc_auc")


def average_precision(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Step-wise average precision (not the trapezoid)."""
    return binary_ranking(df, groups).select(*groups, "average_precision")


def pr_auc_trapezoid(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Trapezoid area under the PR curve including its (0, 1) end."""
    return binary_ranking(df, groups).select(*groups, "pr_auc_trapezoid")


def score_counts(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``(groups..., y_true, class, score, n)``: examples per true class and score of every class.

    One-vs-rest and one-vs-one curves are both sums of these counts, so each example is expanded
    once per class and collapsed in the same stage.
    """
    rows = df.select(*groups, "y_true", F.size("proba").alias("n_classes"), F.posexplode("proba").alias("class", "score"))
    return rows.groupBy(*groups, "n_classes", "y_true", "class", "score").agg(F.count("*").alias("n"))


def one_vs_rest_scores(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Collapsed scores of every class against the rest: ``(groups..., class, score, pos, neg)``."""
    rows = df.select(*groups, "y_true", F.posexplode("proba").alias("class", "p"))
    return collapse_scores(rows, [*groups, "class"], F.col("y_true") == F.col("class"), F.col("p"))


def per_class_auc(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One-vs-rest ROC-AUC and average precision per class."""
    keys = [*groups, "class"]
    return ranking_metrics(cumulative_confusion(one_vs_rest_scores(df, groups), keys), keys)


def averaged_auc(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Macro, class-weighted and micro ROC-AUC and average precision per group.

    The per-class and the pooled curves go through one running-total pass: the pooled curve is the
    class ``-1`` of each group.
    """
    scores = one_vs_rest_scores(df, groups)
    keys = [*groups, "class"]
    pooled = scores.groupBy(*groups, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = scores.unionByName(pooled.withColumn("class", F.lit(-1)))
    ranked = ranking_metrics(cumulative_confusion(both, keys), keys)
    single, micro = F.col("class") >= 0, F.col("class") == -1
    weight = F.when(single & F.col("roc_auc").isNotNull(), F.col("n_pos"))

    def measures(column: str, name: str) -> list[Column]:
        value = F.col(column)
        return [
            F.avg(F.when(single, value)).alias(f"{name}_macro"),
            F.try_divide(F.sum(weight * value), F.sum(weight)).alias(f"{name}_weighted"),
            F.max(F.when(micro, value)).alias(f"{name}_micro"),
        ]

    return ranked.groupBy(*groups).agg(
        *measures("roc_auc", "roc_auc"), *measures("average_precision", "pr_auc")
    )


def ovo_scores(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Collapsed one-vs-one scores ``(groups..., class_a, class_b, direction, score, pos, neg)``.

    The direction of a pair is the class whose score is used.  Examples of that class are its
    positives against every other class; examples of another class are negatives of that one pair.
    """
    counts = score_counts(df, groups)
    own = F.col("y_true") == F.col("class")
    others = F.when(
        own, F.filter(F.sequence(F.lit(0), F.col("n_classes") - 1), lambda c: c != F.col("class"))
    ).otherwise(F.array("y_true"))
    pairs = counts.withColumn("other", F.explode(others))
    zero = F.lit(0).cast("bigint")
    return pairs.groupBy(
        *groups,
        F.least("class", "other").alias("class_a"),
        F.greatest("class", "other").alias("class_b"),
        F.when(F.col("class") < F.col("other"), "a").otherwise("b").alias("direction"),
        "score",
    ).agg(
        F.sum(F.when(own, F.col("n")).otherwise(zero)).alias("pos"),
        F.sum(F.when(own, zero).otherwise(F.col("n"))).alias("neg"),
    )


def ovo_weighted_auc(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Prevalence-weighted one-vs-one AUC next to the class-weighted one-vs-rest AUC."""
    keys = [*groups, "class_a", "class_b", "direction"]
    sided = ranking_metrics(cumulative_confusion(ovo_scores(df, groups), keys), keys)
    pairs = sided.groupBy(*groups, "class_a", "class_b").agg(
        F.avg("roc_auc").alias("auc"), F.max(F.col("n_pos") + F.col("n_neg")).alias("rows")
    )
    ovo = pairs.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("rows") * F.col("auc")), F.sum("rows")).alias("ovo_weighted")
    )
    ovr = averaged_auc(df, groups).select(*groups, F.col("roc_auc_weighted").alias("ovr_weighted"))
    return ovr.join(ovo, list(groups))


def model_auc_comparison(df: DataFrame, model: str = "model") -> DataFrame:
    """Weighted ROC and PR AUC per model with its display name."""
    from labelweave.functions.text import display_name

    scores = averaged_auc(df, [model])
    return scores.select(
        display_name(model).alias("display_name"),
        F.col("roc_auc_weighted").alias("roc_auc"),
        F.col("pr_auc_weighted").alias("pr_auc"),
    )


def random_baseline(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Share of positives: the PR value of a random classifier."""
    return df.groupBy(*groups).agg(
        F.try_divide(F.count_if(F.col("y_true") == 1), F.count("*")).alias("baseline")
    )


def all_metrics(df: DataFrame, groups: Sequence[str], task: str) -> DataFrame:
    """The six metrics of a fold: accuracy, precision, recall, f1, roc_auc, pr_auc."""
    if task == "binary":
        base = classification_metrics(df, groups)
        ranked = binary_ranking(df, groups).select(
            *groups, "roc_auc", F.col("average_precision").alias("pr_auc")
        )
    else:
        base = classification_metrics(df, groups, "macro")
        ranked = averaged_auc(df, groups).select(
            *groups, F.col("roc_auc_macro").alias("roc_auc"), F.col("pr_auc_macro").alias("pr_auc")
        )
    return base.join(ranked, list(groups))


METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def long_metrics(df: DataFrame, groups: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per metric: ``(groups..., metric, value)``."""
    return df.unpivot(list(groups), list(metrics), "metric", "value")


def fold_summary(df: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and population standard deviation over folds."""
    return df.groupBy(*groups).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def metrics_table_from_predictions(df: DataFrame, groups: Sequence[str] = ("run", "model"), task: str = "binary") -> DataFrame:
    """Metrics of the predictions of all folds pooled per run and model."""
    return all_metrics(df, groups, task)
