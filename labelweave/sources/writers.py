"""Writers.  Each writes from all tasks; none gathers a group first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.functions.text import yes_no


def write_tsv(df: DataFrame, path: str, order: Sequence[str] | None = None) -> None:
    """TSV with header; booleans become Yes / No, rows are range-sorted only when asked."""
    out = df.select(
        *[
            yes_no(f.name).alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    if order:
        out = out.orderBy(*order)
    out.write.csv(path, sep="\t", header=True)


def write_predictions_json(df: DataFrame, path: str, partitions: Sequence[str] = ("run", "model")) -> None:
    """Predictions as JSON rows partitioned by run and model, which ``read_predictions`` reads back.

    One row per example, so a model with very many predictions never becomes a single array.  Rows are
    rebalanced by folder first: a folder gets few files, a large one several.
    """
    df.hint("rebalance", *[F.col(c) for c in partitions]).write.partitionBy(*partitions).json(path)


def write_metric_tables(df: DataFrame, path: str, partitions: Sequence[str] = ("run", "model")) -> None:
    """Long metric rows ``(run, model, fold, split, metric, value)`` as partitioned Parquet."""
    df.hint("rebalance", *[F.col(c) for c in partitions]).write.partitionBy(*partitions).parquet(path)


def write_model_partitions(df: DataFrame, path: str, column: str = "model") -> None:
    """One folder per model (the tabular form of one sheet per model)."""
    df.hint("rebalance", F.col(column)).write.partitionBy(column).parquet(path)
