"""Ordered de-duplication and unions with a priority of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.operators.ordering import first_rows


def _reversed(order: Sequence[Column | str]) -> list[Column]:
    return [(F.col(o) if isinstance(o, str) else o).desc() for o in order]


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return first_rows(df, keys, order)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the last in ``order`` (columns given in ascending sense)."""
    return first_rows(df, keys, _reversed(order))


def concat_sources(frames: Sequence[DataFrame], source_column: str = "source_rank") -> DataFrame:
    """Bag union of frames, tagged with the position of each frame (its priority)."""
    tagged = [df.withColumn(source_column, F.lit(i)) for i, df in enumerate(frames)]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df)
    return result


def union_first(
    frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """Union of frames keeping, per key, the row of the earliest frame."""
    tagged = concat_sources(frames)
    return dedupe_first(tagged, keys, ["source_rank", *order]).drop("source_rank")
