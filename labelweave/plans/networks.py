"""Interaction networks to vertex features with labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from labelweave.operators.graph import clean_network, union_networks, vertex_feature_table, vertices
from labelweave.operators.labels import enrich_nodes, restrict_to_network
from labelweave.runtime import stage


def united_network(networks: Mapping[str, DataFrame], mapping: DataFrame) -> DataFrame:
    """Cleaned networks as one, with the networks each edge comes from."""
    table = stage(mapping, "mapping")
    return union_networks({name: clean_network(edges, table) for name, edges in networks.items()})


def network_dataset(
    networks: Mapping[str, DataFrame],
    mapping: DataFrame,
    features: DataFrame,
    labels: DataFrame,
    batch: int | None = None,
) -> DataFrame:
    """Scaled vertex measures of the united network with features and labels.

    ``features`` and ``labels`` are keyed by ``vertex``; ``batch`` bounds the sources per search.
    """
    edges = stage(united_network(networks, mapping).select("src", "dst"), "united")
    measures = vertex_feature_table(edges, batch)
    known = restrict_to_network(labels, vertices(edges), "vertex")
    return enrich_nodes(measures, features, known, "vertex")
