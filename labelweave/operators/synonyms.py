"""Synonym dictionaries and their application to lists, labels and edges.

A dictionary is a table ``(input, match_type, approved, seq)``; ``seq`` is the order of its rows.
Joins carry no broadcast hint: Catalyst and AQE broadcast the dictionary when its measured size is
below the session's threshold and otherwise shuffle, splitting skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.operators.dedupe import dedupe_first, dedupe_last, union_first

#: Match types of a dictionary row.
MAPPED_TYPES = ("Approved symbol", "Alias symbol", "Previous symbol")
UNMATCHED = "Unmatched"
WITHDRAWN = "Entry withdrawn"


def build_synonym_map(dictionary: DataFrame) -> DataFrame:
    """``(input, approved)`` of the mapped rows; the last duplicate of an input wins."""
    mapped = dictionary.filter(F.col("match_type").isin(*MAPPED_TYPES))
    return dedupe_last(mapped, ["input"], ["seq"]).select("input", "approved")


def unresolved_inputs(dictionary: DataFrame) -> DataFrame:
    """Unmatched and withdrawn rows, with ``N/A`` where there is no approved symbol."""
    rows = dictionary.filter(F.col("match_type").isin(UNMATCHED, WITHDRAWN))
    return rows.select("input", "match_type", F.coalesce("approved", F.lit("N/A")).alias("approved"))


def first_match_dictionary(dictionaries: Sequence[DataFrame]) -> DataFrame:
    """``(input, approved)`` where the first duplicate wins, within and across dictionaries."""
    return union_first(dictionaries, ["input"], ["seq"]).select("input", "approved")


def symbol_lookup(mapping: DataFrame) -> DataFrame:
    """``(_name, _symbol)``: every name that the mapping knows, once, with the symbol it stands for.

    An input stands for its approved symbol, or for itself without one; an approved symbol that is no
    input stands for itself.  One inner join with this table both translates names and drops unknown ones.
    """
    inputs = mapping.filter("input IS NOT NULL").select(
        F.col("input").alias("_name"), F.coalesce("approved", "input").alias("_symbol"), F.lit(0).alias("_rank")
    )
    approved = mapping.filter("approved IS NOT NULL").select(
        F.col("approved").alias("_name"), F.col("approved").alias("_symbol"), F.lit(1).alias("_rank")
    )
    return inputs.unionByName(approved).groupBy("_name").agg(F.min_by("_symbol", "_rank").alias("_symbol"))


def resolve_symbols(df: DataFrame, mapping: DataFrame, column: str = "symbol") -> DataFrame:
    """All rows whose symbol the mapping knows, with the approved symbol; repeated symbols stay."""
    joined = df.join(symbol_lookup(mapping), F.col(column) == F.col("_name"))
    return joined.withColumn(column, F.col("_symbol")).select(*df.columns)


def apply_synonyms(
    df: DataFrame,
    mapping: DataFrame,
    column: str = "symbol",
    order: Sequence[str] = ("row_id",),
    merge_flags: bool = False,
    flags: Sequence[str] = ("oncogene", "tsg"),
) -> DataFrame:
    """Approved symbols of a list; unknown symbols are dropped, the first row per symbol is kept.

    With ``merge_flags`` the flags of all rows that map to one symbol are or-ed instead.
    """
    known = resolve_symbols(df, mapping, column)
    if merge_flags:
        return known.groupBy(column).agg(*[F.bool_or(c).alias(c) for c in flags])
    return dedupe_first(known, [column], order)


def removed_symbols(df: DataFrame, mapping: DataFrame, column: str = "symbol") -> DataFrame:
    """Symbols that ``apply_synonyms`` rejects."""
    known = symbol_lookup(mapping).select(F.col("_name").alias(column))
    return df.select(column).join(known, column, "left_anti").distinct()


def _translation(mapping: DataFrame, column: str) -> DataFrame:
    return mapping.select(
        F.col("input").alias(column),
        F.col("approved").alias(f"_{column}_new"),
        F.lit(True).alias(f"_{column}_known"),
    )


def _translated(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    joined = df.join(_translation(mapping, column), column, "left")
    return (
        joined.withColumn(
            column, F.when(F.col(f"_{column}_known"), F.col(f"_{column}_new")).otherwise(F.col(column))
        )
        .filter(F.col(column).isNotNull())
        .select(*df.columns)
    )


def translate_edges(edges: DataFrame, mapping: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Dictionary replacement on both endpoints.

    A name outside the dictionary stays; a name the dictionary maps to nothing drops the edge.
    """
    return _translated(_translated(edges, mapping, src), mapping, dst)


def translate_labels(
    labels: DataFrame, mapping: DataFrame, column: str, order: Sequence[str]
) -> DataFrame:
    """Translated keys without nulls, the first row per key."""
    return dedupe_first(_translated(labels, mapping, column), [column], order)


def resolve_edge_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src_id, dst_id)`` edges as ``(src, dst)`` names, joined on the node id."""
    names = nodes.select("id", "name")
    by_src = names.withColumnsRenamed({"id": "src_id", "name": "src"})
    by_dst = names.withColumnsRenamed({"id": "dst_id", "name": "dst"})
    return edges.join(by_src, "src_id").join(by_dst, "dst_id").select("src", "dst")
