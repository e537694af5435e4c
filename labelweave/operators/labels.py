"""Entity lists, labels and their alignment with features and networks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.operators.clean import filter_any_flag
from labelweave.operators.dedupe import union_first
from labelweave.operators.synonyms import resolve_symbols

FLAGS = ("oncogene", "tsg")


def any_flag_by_key(df: DataFrame, key: str = "symbol", flags: Sequence[str] = FLAGS) -> DataFrame:
    """One row per key; a flag is set when any row sets it (partial aggregation, no UDF)."""
    return df.groupBy(key).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags])


def _listed(
    sources: Sequence[DataFrame],
    unmapped: Sequence[DataFrame],
    mapping: DataFrame,
    key: str,
    merge_flags: bool = False,
    order: Sequence[str] = ("row_id",),
) -> DataFrame:
    """One row per key of all sources, a flag set when any source sets it.

    The sources are tagged and united before the synonyms are applied, so there is one join with the
    dictionary and one shuffle, whatever the number of sources.  Without ``merge_flags`` a source speaks
    through the first of its rows per key; sources in ``unmapped`` keep their names and count with all rows.
    """
    place = F.struct(*order)
    tagged = [
        s.select(key, *FLAGS, (F.lit(None) if merge_flags else place).alias("_place"), F.lit(i).alias("_source"))
        for i, s in enumerate(sources)
    ]
    rows = resolve_symbols(reduce(DataFrame.unionByName, tagged), mapping, key).select(key, "_place", "_source", *FLAGS)
    for s in unmapped:
        plain = s.dropna(subset=[key]).select(key, F.lit(None).alias("_place"), F.lit(-1).alias("_source"), *FLAGS)
        rows = rows.unionByName(plain)
    if merge_flags:
        return any_flag_by_key(rows, key)
    flags = F.struct(*FLAGS)
    firsts = [
        F.min_by(F.when(F.col("_source") == i, flags), F.when(F.col("_source") == i, F.col("_place"))).alias(f"_first_{i}")
        for i in range(len(sources))
    ]
    every = [F.bool_or(F.when(F.col("_source") == -1, F.col(c))).alias(f"_any_{c}") for c in FLAGS]
    united = rows.groupBy(key).agg(*firsts, *every)

    def flag(c: str):
        said = [F.col(f"_first_{i}.{c}") for i in range(len(sources))]
        return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in (*said, F.col(f"_any_{c}"))]).alias(c)

    return united.select(key, *[flag(c) for c in FLAGS])


def canonical_list(
    sources: Sequence[DataFrame],
    mapping: DataFrame,
    key: str = "symbol",
    merge_flags: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Keys that any source flags, after synonyms; sorted by key unless an intermediate step."""
    listed = filter_any_flag(_listed(sources, (), mapping, key, merge_flags))
    return listed.orderBy(key) if ordered else listed


def candidate_list(
    sources: Sequence[DataFrame],
    unmapped_sources: Sequence[DataFrame],
    mapping: DataFrame,
    key: str = "symbol",
    ordered: bool = True,
) -> DataFrame:
    """Candidates of all sources; the pathway-like sources are taken without synonyms."""
    listed = _listed(sources, unmapped_sources, mapping, key)
    return listed.orderBy(key) if ordered else listed


def disease_associated_list(
    members: DataFrame, others: DataFrame, key: str = "symbol", order: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Members of pathways followed by a second list; the first occurrence wins."""
    return union_first([members, others], [key], order)


def assign_labels(
    universe: DataFrame, canonical: DataFrame, candidate: DataFrame, key: str = "symbol"
) -> DataFrame:
    """``(key, label2, label3)`` for every key of the three inputs.

    Canonical keys are 1, candidates unlabeled (null), all others 0.  In ``label3`` a canonical key
    is 1 when its tsg flag is set, else 2 when its oncogene flag is set, else 0.
    """
    # Union and aggregate instead of three joins: one shuffle, and repeated keys of the universe
    # collapse before it.
    rows = reduce(
        DataFrame.unionByName,
        [
            universe.select(
                key,
                F.lit(False).alias("canonical"),
                F.lit(False).alias("candidate"),
                F.lit(False).alias("oncogene"),
                F.lit(False).alias("tsg"),
            ),
            canonical.select(key, F.lit(True).alias("canonical"), F.lit(False).alias("candidate"), *FLAGS),
            candidate.select(
                key,
                F.lit(False).alias("canonical"),
                F.lit(True).alias("candidate"),
                F.lit(False).alias("oncogene"),
                F.lit(False).alias("tsg"),
            ),
        ],
    )
    merged = rows.groupBy(key).agg(*[F.bool_or(c).alias(c) for c in ("canonical", "candidate", *FLAGS)])
    label2 = F.when(F.col("canonical"), 1).when(F.col("candidate"), F.lit(None)).otherwise(0)
    label3 = (
        F.when(F.col("canonical") & F.col("tsg"), 1)
        .when(F.col("canonical") & F.col("oncogene"), 2)
        .when(F.col("canonical"), 0)
        .when(F.col("candidate"), F.lit(None))
        .otherwise(0)
    )
    return merged.select(key, label2.cast("int").alias("label2"), label3.cast("int").alias("label3"))


def tri_state_label(df: DataFrame, driver: str, candidate: str, name: str = "label") -> DataFrame:
    """Two membership flags to True / null / False; both set is illegal and raises at run time."""
    both = F.col(driver) & F.col(candidate)
    value = F.when(
        both, F.raise_error(F.lit("a key is both a driver and a candidate")).cast("boolean")
    ).when(F.col(driver), True).when(F.col(candidate), F.lit(None)).otherwise(False)
    return df.withColumn(name, value)


def illegal_memberships(df: DataFrame, driver: str, candidate: str) -> DataFrame:
    """Number of rows where both flags are set."""
    return df.agg(F.count_if(F.col(driver) & F.col(candidate)).alias("n_illegal"))


def prepare_labels(df: DataFrame, key: str, task: str = "binary") -> DataFrame:
    """``(key, label)`` of a task, without unlabeled keys."""
    columns = {"binary": "label2", "multiclass": "label3"}
    if task not in columns:
        raise ValueError(f"unknown task {task!r}")
    return df.select(key, F.col(columns[task]).cast("int").alias("label")).dropna(subset=["label"])


def label_stats(df: DataFrame, label: str, classes: Sequence[int]) -> DataFrame:
    """Rows, unlabeled rows and rows per class in one pass."""
    return df.agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col(label).isNull()).alias("n_unlabeled"),
        *[F.count_if(F.col(label) == c).alias(f"n_class_{c}") for c in classes],
    )


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Positives per negative; infinite without negatives."""
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("n_positive"),
        F.count_if(F.col(label) == 0).alias("n_negative"),
    )
    ratio = F.when(F.col("n_negative") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide(F.col("n_positive"), F.col("n_negative"))
    )
    return counts.withColumn("ratio", ratio)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def align_features_labels(features: DataFrame, labels: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Features and labels of the common keys.  With ``check``, repeated keys raise."""
    if check:
        for name, df in (("features", features), ("labels", labels)):
            if not duplicate_keys(df, key).isEmpty():
                raise ValueError(f"{name} repeat a key of {key!r}")
    return features.join(labels, key)


def prepare_dataset(
    features: DataFrame, labels: DataFrame, key: str, task: str = "binary", fill: float | None = 0.0
) -> DataFrame:
    """``(key, features, label)`` ready for splitting, from either label layout."""
    if "label" in labels.columns:
        from labelweave.operators.clean import recode_label

        target = recode_label(labels.select(key, "label"), "label").dropna(subset=["label"])
    else:
        target = prepare_labels(labels, key, task)
    aligned = align_features_labels(features, target, key)
    vector = F.transform(
        "features", lambda x: F.coalesce(x.cast("double"), F.lit(fill)) if fill is not None else x.cast("double")
    )
    return aligned.select(key, vector.alias("features"), "label")


def three_way_unlabeled(
    candidates: DataFrame, associated: DataFrame, canonical: DataFrame, key: str = "symbol"
) -> DataFrame:
    """Candidates and associated keys without the canonical ones; candidates win duplicates."""
    merged = union_first(
        [
            candidates.select(key, F.lit("candidate").alias("origin")),
            associated.select(key, F.lit("associated").alias("origin")),
        ],
        [key],
        [key],
    )
    return merged.join(canonical.select(key), key, "left_anti")


def exclude_canonical(candidates: DataFrame, canonical: DataFrame, key: str = "symbol") -> DataFrame:
    return candidates.join(canonical.select(key), key, "left_anti")


def membership_flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Does the key occur in ``other``?"""
    keys = other.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(keys, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def enrich_nodes(
    vertices: DataFrame, features: DataFrame, labels: DataFrame, key: str, drop: Sequence[str] = ()
) -> DataFrame:
    """Vertices with features and labels; measure columns may be dropped before the joins."""
    return vertices.drop(*drop).join(features, key, "left").join(labels, key, "left")


def restrict_to_network(labels: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """Labels of the keys that are vertices of a network."""
    return labels.join(vertices.select(key), key, "left_semi")


def feature_dictionary_union(frames: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Feature tables of several networks; the earliest table wins a key."""
    return union_first(frames, [key], order)


def label_union(frames: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Label tables of several networks, the earliest wins, sorted by key."""
    return union_first(frames, [key], order).orderBy(key)
