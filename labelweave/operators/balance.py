"""Class balancing of training rows ``(key STRING, features ARRAY<DOUBLE>, label INT)``.

Every choice (which rows stay, which neighbour, how far along the segment) is a hash of the row,
so a retried task repeats it.  Class sizes are the only values the driver sees.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.hashing import hash_hex, hash_unit
from labelweave.operators.neighbors import knn_join
from labelweave.operators.ordering import row_numbers
from labelweave.runtime import stage

MAX_CLASSES = 1000


def _points(df: DataFrame) -> DataFrame:
    return stage(
        df.select(
            F.col("key").cast("string").alias("key"),
            F.col("features").cast("array<double>").alias("features"),
            F.col("label").cast("int").alias("label"),
        ),
        "points",
    )


def class_counts(df: DataFrame) -> dict[int, int]:
    """Class sizes; balancing makes a plan for each class, so more than ``MAX_CLASSES`` of them are an error."""
    rows = df.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: is the label column right?")
    return {r.label: r.n for r in rows}


def undersample_random(df: DataFrame, seed: int = 42) -> DataFrame:
    """Every class down to the size of the smallest."""
    smallest = df.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    numbered = row_numbers(
        df.withColumn("_hash", hash_hex(seed, "key")), ["label"], ["_hash", "key"], "_rn"
    )
    return numbered.filter(F.col("_rn") <= smallest).select(*df.columns)


def _interpolate(members: DataFrame, copies: DataFrame, label: int, k: int, seed: int) -> DataFrame:
    """Synthetic points on segments from a member to one of its ``k`` nearest fellow members.

    ``copies`` is ``(key, n)``: how many points start at each member.
    """
    near = knn_join(members, members, k, exclude_self=True).select(
        F.col("query_id").alias("key"), "neighbor_id", "rank"
    )
    wanted = copies.filter("n > 0").select("key", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    chosen = wanted.select(
        "key",
        "copy",
        (F.floor(hash_unit(f"{seed}n", "key", "copy") * k) + 1).cast("int").alias("rank"),
        hash_unit(f"{seed}u", "key", "copy").alias("u"),
    )
    other = members.select(F.col("key").alias("neighbor_id"), F.col("features").alias("other"))
    segments = chosen.join(near, ["key", "rank"]).join(members.select("key", "features"), "key").join(other, "neighbor_id")
    return segments.select(
        F.concat_ws("#", F.lit("synthetic"), F.lit(str(label)), "key", "copy").alias("key"),
        F.zip_with("features", "other", lambda a, b: a + F.col("u") * (b - a)).alias("features"),
        F.lit(label).alias("label"),
    )


def _even_copies(members: DataFrame, n_members: int, needed: int, seed: int) -> DataFrame:
    """``needed`` copies spread evenly; the first members in hash order take the remainder."""
    numbered = row_numbers(
        members.select("key", hash_hex(f"{seed}c", "key").alias("_hash")), [], ["_hash", "key"], "_rn"
    )
    extra = (F.col("_rn") <= needed % n_members).cast("int")
    return numbered.select("key", (F.lit(needed // n_members) + extra).alias("n"))


def _united(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def smote(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Raise every class to the size of the largest with interpolated points."""
    points = _points(df)
    counts = class_counts(points)
    largest = max(counts.values())
    frames = [points]
    for label, n in counts.items():
        if n == largest:
            continue
        if n <= k:
            raise ValueError(f"class {label} has {n} rows; {k} neighbours need at least {k + 1}")
        members = stage(points.filter(F.col("label") == label), "members")
        frames.append(_interpolate(members, _even_copies(members, n, largest - n, seed), label, k, seed))
    return _united(frames)


def adasyn(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Like ``smote``, with more points where more of the neighbours belong to other classes."""
    points = _points(df)
    counts = class_counts(points)
    largest = max(counts.values())
    labels = points.select(F.col("key").alias("neighbor_id"), F.col("label").alias("neighbor_label"))
    frames = [points]
    for label, n in counts.items():
        if n == largest:
            continue
        if n <= k:
            raise ValueError(f"class {label} has {n} rows; {k} neighbours need at least {k + 1}")
        members = stage(points.filter(F.col("label") == label), "members")
        near = stage(knn_join(members, points, k, exclude_self=True), "near")
        hardness = (
            near.join(labels, "neighbor_id")
            .groupBy(F.col("query_id").alias("key"))
            .agg((F.count_if(F.col("neighbor_label") != label) / F.lit(float(k))).alias("hardness"))
        )
        hardness = stage(hardness, "hardness")
        total = hardness.agg(F.sum("hardness")).first()[0]
        if not total:
            raise ValueError(f"no neighbour of class {label} belongs to another class")
        copies = hardness.select("key", F.rint(F.col("hardness") / total * (largest - n)).cast("int").alias("n"))
        frames.append(_interpolate(members, copies, label, k, seed))
    return _united(frames)


def _cleaned_classes(counts: dict[int, int], all_classes: bool) -> list[int]:
    """Classes a cleaning step may remove from: all, or all but the smallest."""
    if all_classes:
        return list(counts)
    smallest = min(counts, key=lambda c: (counts[c], c))
    return [c for c in counts if c != smallest]


def tomek_links(df: DataFrame, all_classes: bool = False) -> DataFrame:
    """Remove members of mutual nearest-neighbour pairs of different classes."""
    points = _points(df)
    near = stage(knn_join(points, points, 1, exclude_self=True), "near").select("query_id", "neighbor_id")
    back = near.select(F.col("neighbor_id").alias("query_id"), F.col("query_id").alias("neighbor_id"))
    mutual = near.join(back, ["query_id", "neighbor_id"])
    labels = points.select("key", "label")
    pairs = mutual.join(
        labels.withColumnsRenamed({"key": "query_id", "label": "own"}), "query_id"
    ).join(labels.withColumnsRenamed({"key": "neighbor_id", "label": "other"}), "neighbor_id")
    removable = _cleaned_classes(class_counts(points), all_classes)
    links = pairs.filter((F.col("own") != F.col("other")) & F.col("own").isin(removable))
    return points.join(links.select(F.col("query_id").alias("key")), "key", "left_anti")


def edited_nn(df: DataFrame, k: int = 3, all_classes: bool = False) -> DataFrame:
    """Keep a removable row only when all of its ``k`` neighbours share its class."""
    points = _points(df)
    near = knn_join(points, points, k, exclude_self=True)
    labels = points.select("key", "label")
    judged = (
        near.join(labels.withColumnsRenamed({"key": "neighbor_id", "label": "other"}), "neighbor_id")
        .join(labels.withColumnsRenamed({"key": "query_id", "label": "own"}), "query_id")
        .groupBy("query_id", "own")
        .agg(F.bool_and(F.col("own") == F.col("other")).alias("agrees"))
    )
    removable = _cleaned_classes(class_counts(points), all_classes)
    wrong = judged.filter(~F.col("agrees") & F.col("own").isin(removable))
    return points.join(wrong.select(F.col("query_id").alias("key")), "key", "left_anti")


def smote_enn(df: DataFrame, k: int = 5, seed: int = 42, all_classes: bool = True) -> DataFrame:
    return edited_nn(smote(df, k, seed), 3, all_classes)


def smote_tomek(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    return tomek_links(smote(df, k, seed), all_classes=True)


def kmeans_smote(df: DataFrame, k: int = 2, clusters: int = 8, seed: int = 42) -> DataFrame:
    """SMOTE inside clusters where a small class is dense enough, more points in sparse clusters.

    The spread of a cluster is the root mean square distance of its members, which follows from
    the variances in one pass, so no pairs of members are formed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = _points(df)
    counts = class_counts(points)
    largest, total = max(counts.values()), sum(counts.values())
    vectors = points.withColumn("vector", array_to_vector("features"))
    model = KMeans(k=clusters, seed=seed, featuresCol="vector", predictionCol="cluster").fit(vectors)
    placed = stage(model.transform(vectors).drop("vector"), "clustered")
    dims = len(model.clusterCenters()[0])
    density_exponent = math.log(total, 1.6) ** 1.8 * 0.16
    frames = [points]
    for label, n in counts.items():
        if n == largest:
            continue
        needed = largest - n
        threshold = needed / total / 2
        own = F.col("label") == label
        stats = (
            placed.groupBy("cluster")
            .agg(
                F.count("*").alias("size"),
                F.count_if(own).alias("members"),
                *[F.var_samp(F.when(own, F.get("features", F.lit(i)))).alias(f"v{i}") for i in range(dims)],
            )
            .collect()
        )
        spread = {}
        for row in stats:
            if row.members > k and row.members / row["size"] >= threshold:
                mean_square = 2 * sum(row[f"v{i}"] or 0.0 for i in range(dims))
                spread[row.cluster] = (row.members, math.sqrt(mean_square) ** density_exponent / row.members)
        if not spread:
            raise ValueError(f"no cluster holds enough rows of class {label}")
        scale = sum(s for _, s in spread.values())
        for cluster, (members, sparsity) in spread.items():
            share = math.ceil(needed * (sparsity / scale if scale else 1 / len(spread)))
            chosen = stage(placed.filter(own & (F.col("cluster") == cluster)).drop("cluster"), "members")
            copies = _even_copies(chosen, members, share, seed)
            made = _interpolate(chosen, copies, label, k, seed)
            frames.append(made.withColumn("key", F.concat_ws("#", "key", F.lit(f"c{cluster}"))))
    return _united(frames)


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "none": lambda df: df,
    "smote": smote,
    "adasyn": adasyn,
    "randomundersampler": undersample_random,
    "smoteenn": smote_enn,
    "smotetomek": smote_tomek,
    "tomeklinks": tomek_links,
    "kmeanssmote": kmeans_smote,
    # the search uses three neighbours and cleans the larger classes only
    "smoteenn_search": lambda df: smote_enn(df, k=3, all_classes=False),
}
STRATEGIES["smoten"] = STRATEGIES["smote"]


def register_strategy(name: str, function: Callable[[DataFrame], DataFrame]) -> None:
    STRATEGIES[name] = function


def balance(df: DataFrame, strategy: str | None) -> DataFrame:
    """Apply a balancing strategy by name."""
    name = strategy or "none"
    if name not in STRATEGIES:
        raise ValueError(f"unknown balancing strategy {strategy!r}; known are {sorted(STRATEGIES)}")
    return STRATEGIES[name](df)
