"""Running totals and row numbers over groups of any size.

A plain window sorts each group inside one task, which fails when one group holds a large part of
all rows.  Here the rows are range-partitioned by (group, order), so a hot group spreads over many
partitions; each partition numbers its own rows, and the totals of the partitions before it are
added.  Only one small row per (group, partition) is summed across partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.runtime import stage

_PART = "_part"


def _columns(items: Sequence[Column | str]) -> list[Column]:
    return [F.col(i) if isinstance(i, str) else i for i in items]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys equal each other; the left side's keys stay."""
    renamed = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(renamed)
    on = [left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*renamed.values())


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column | str],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Add cumulative sums (first row up to the current one) per group in a total order.

    ``order`` should be total within a group.  Null group values form a group of their own.
    """
    groups = list(groups)
    order = _columns(order)
    placed = stage(
        df.repartitionByRange(*_columns(groups), *order).withColumn(_PART, F.spark_partition_id()),
        "ranged",
    )
    local = (
        Window.partitionBy(*groups, _PART)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    per_part = placed.groupBy(*groups, _PART).agg(
        *[F.sum(expr).alias(f"_sum_{name}") for name, expr in totals.items()]
    )
    before = (
        Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_part.select(
        *groups,
        _PART,
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}")
            for name in totals
        ],
    )
    result = placed.select(
        *placed.columns, *[F.sum(expr).over(local).alias(f"_local_{name}") for name, expr in totals.items()]
    )
    result = join_null_safe(result, offsets, [*groups, _PART])
    kept = [c for c in placed.columns if c != _PART]
    return result.select(
        *kept, *[(F.col(f"_local_{n}") + F.col(f"_before_{n}")).alias(n) for n in totals]
    )


def row_numbers(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str = "row_number"
) -> DataFrame:
    """Number the rows of each group from 1 in a total order, for groups of any size."""
    return running_totals(df, groups, order, {name: F.lit(1).cast("bigint")})


def first_rows(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column | str],
    k: int = 1,
    rank_column: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of each group in a total order.

    Spark keeps only ``k`` rows per group and map task before the shuffle (window group limit),
    so a hot group ships ``k`` rows per task, not all of its rows.
    """
    name = rank_column or "_rank"
    window = Window.partitionBy(*groups).orderBy(*_columns(order))
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return ranked if rank_column else ranked.drop(name)
