"""Deterministic splits and class weights.

Rows are ordered by a hash of their key, so a split depends on the keys and the seed only.
Numbering uses the distributed row numbers: neither a dominant class nor the whole table ever
passes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.hashing import hash_hex
from labelweave.operators.ordering import join_null_safe, row_numbers


def _numbered(df: DataFrame, groups: list[str], key: str, seed: int) -> DataFrame:
    hashed = df.withColumn("_hash", hash_hex(seed, key))
    return row_numbers(hashed, groups, ["_hash", key], "_rn").drop("_hash")


def class_sizes(df: DataFrame, label: str, *more: str) -> DataFrame:
    """Rows per class; one row per class."""
    return df.groupBy(label, *more).agg(F.count("*").alias("class_size"))


def stratified_holdout(
    df: DataFrame, key: str, label: str, fraction: float = 0.2, seed: int = 42, name: str = "is_test"
) -> DataFrame:
    """Marks ``round(fraction * n)`` rows of every class as test rows; rows without a label are a class."""
    numbered = _numbered(df, [label], key, seed)
    cut = F.round(F.col("class_size") * fraction)
    return join_null_safe(numbered, class_sizes(df, label), [label]).select(*df.columns, (F.col("_rn") <= cut).alias(name))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Shuffled, unstratified folds 0 .. k-1 whose sizes differ by at most one."""
    numbered = _numbered(df, [], key, seed)
    return numbered.select(*df.columns, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int").alias(name))


def stratified_kfold(
    df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Shuffled folds with every class spread evenly."""
    numbered = _numbered(df, [label], key, seed)
    return numbered.select(*df.columns, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int").alias(name))


def nested_folds(
    df: DataFrame, key: str, label: str, outer: int = 5, inner: int = 5, seed: int = 42
) -> DataFrame:
    """Every row once per outer fold: ``outer_fold``, ``role`` and, for training rows, ``inner_fold``."""
    folds = stratified_kfold(df, key, label, outer, seed, "_own")
    repeated = folds.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    marked = repeated.withColumn(
        "role", F.when(F.col("outer_fold") == F.col("_own"), "test").otherwise("train")
    )
    numbered = _numbered(marked, ["outer_fold", "role", label], key, seed + 1)
    inner_fold = F.when(F.col("role") == "train", F.pmod(F.col("_rn") - 1, F.lit(inner)).cast("int"))
    return numbered.select(*df.columns, "outer_fold", "role", inner_fold.alias("inner_fold"))


def balanced_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Adds ``n / (classes * class size)`` to every row."""
    sizes = class_sizes(df, label)
    totals = sizes.agg(F.struct(F.sum("class_size").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    weights = sizes.select(
        label, (totals.getField("n") / (totals.getField("k") * F.col("class_size"))).alias(name)
    )
    return join_null_safe(df, weights, [label])


#: Fixed value: ratio of negatives to positives assumed by the search spaces.
IMBALANCE_RATIO = 93.0 / 7.0


def imbalance_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive, from the data, next to the assumed constant."""
    return df.agg(
        F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("ratio"),
        F.lit(IMBALANCE_RATIO).alias("assumed"),
    )
