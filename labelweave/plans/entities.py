"""Curated lists to labelled entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from labelweave.operators.labels import (
    align_features_labels,
    assign_labels,
    candidate_list,
    canonical_list,
    prepare_labels,
)
from labelweave.runtime import stage


def label_entities(
    universe: DataFrame,
    canonical_sources: Sequence[DataFrame],
    candidate_sources: Sequence[DataFrame],
    pathway_sources: Sequence[DataFrame],
    mapping: DataFrame,
    key: str = "symbol",
) -> DataFrame:
    """Lists to labels in one plan: synonyms, consolidation and priority labels."""
    # staged once: its file size is known, so Catalyst can broadcast it to every source's join
    mapping = stage(mapping, "mapping")
    canonical = canonical_list(canonical_sources, mapping, key, ordered=False)
    candidate = candidate_list(candidate_sources, pathway_sources, mapping, key, ordered=False)
    return assign_labels(universe, canonical, candidate, key)


def labelled_features(
    labels: DataFrame, features: DataFrame, key: str = "symbol", task: str = "binary"
) -> DataFrame:
    """Features of the labelled entities, ready for splitting."""
    return align_features_labels(features, prepare_labels(labels, key, task), key)
