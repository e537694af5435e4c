"""Undirected networks as edge tables ``(src, dst)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.operators.clean import drop_self_loops
from labelweave.operators.ordering import row_numbers
from labelweave.operators.synonyms import translate_edges
from labelweave.runtime import stage


def canonicalize_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Endpoints in ascending order."""
    return edges.withColumns({src: F.least(src, dst), dst: F.greatest(src, dst)})


def dedupe_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row per unordered pair (duplicates collapse before the shuffle)."""
    return canonicalize_edges(edges, src, dst).select(src, dst).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(vertex, component)``: the smallest vertex that can be reached, itself included.

    Alternating stars: every vertex links its larger neighbours to the smallest vertex around it, then its smaller ones.  Links only move
    to smaller vertices, so hubs stay stars, and the rounds grow with the logarithm of a component's length.
    """

    def state_of(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())

    links = stage(dedupe_edges(edges).filter("src <> dst"), "links")
    seen = state_of(links)
    while True:
        arcs = links.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
        lowest = arcs.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        # pairs (larger vertex, smaller vertex)
        large = stage(arcs.filter("dst > src").join(lowest, "src").select(F.col("dst").alias("up"), F.col("low").alias("down")).distinct(), "large")
        root = large.groupBy("up").agg(F.min("down").alias("low"))
        small = large.join(root, "up").filter("down <> low").select(F.col("low").alias("src"), F.col("down").alias("dst"))
        links = stage(small.union(root.select(F.col("low").alias("src"), F.col("up").alias("dst"))).distinct(), "links")
        now = state_of(links)
        if now == seen:
            break
        seen = now
    found = links.select(F.col("dst").alias("vertex"), F.col("src").alias("component"))
    return vertices(edges).join(found, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))


def edge_key_collisions(edges: DataFrame) -> DataFrame:
    """Concatenated keys shared by different pairs, with the number of pairs."""
    pairs = dedupe_edges(edges)
    keyed = pairs.groupBy(F.concat(F.col("src").cast("string"), F.col("dst").cast("string")).alias("edge_key"))
    return keyed.agg(F.count("*").alias("n_pairs")).filter("n_pairs > 1")


def union_networks(networks: Mapping[str, DataFrame]) -> DataFrame:
    """Union of networks with the sorted names of the networks each edge occurs in."""
    tagged = [
        canonicalize_edges(e.select("src", "dst")).withColumn("source", F.lit(name))
        for name, e in networks.items()
    ]
    united = reduce(DataFrame.unionByName, tagged)
    return united.groupBy("src", "dst").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def clean_network(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Translate, drop nulls and self loops, order endpoints and de-duplicate.

    With a dictionary small enough to broadcast the only shuffle is the final de-duplication,
    which collapses repeated edges per task first; with a larger one AQE splits hot endpoints.
    """
    pairs = edges.select("src", "dst").dropna()
    return dedupe_edges(drop_self_loops(translate_edges(pairs, mapping)))


def induced_subgraph(edges: DataFrame, keep: DataFrame, key: str = "vertex") -> DataFrame:
    """Edges whose both endpoints are kept."""
    ids = keep.select(key).distinct()
    with_src = edges.join(ids.withColumnRenamed(key, "src"), "src", "left_semi")
    return with_src.join(ids.withColumnRenamed(key, "dst"), "dst", "left_semi").select("src", "dst")


def degree(edges: DataFrame) -> DataFrame:
    """``(vertex, degree)``; counts are combined per task before the shuffle."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vertex"))
    return ends.groupBy("vertex").agg(F.count("*").alias("degree"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """Vertices, edges and density."""
    totals = degree(edges).agg(F.count("*").alias("n_vertices"), F.sum("degree").alias("ends"))
    n, m = F.col("n_vertices"), (F.col("ends") / 2).cast("bigint")
    return totals.select("n_vertices", m.alias("n_edges"), F.try_divide(F.lit(2.0) * m, n * (n - 1)).alias("density"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """Mean and maximum degree and the smallest vertex that attains the maximum."""
    return degree(edges).agg(
        F.avg("degree").alias("mean_degree"),
        F.max("degree").alias("max_degree"),
        F.min_by("vertex", F.struct(-F.col("degree"), F.col("vertex"))).alias("max_vertex"),
    )


def degree_distribution(edges: DataFrame) -> DataFrame:
    """``(degree, n)`` and whether it is the modal degree (smallest on ties)."""
    # one row per distinct degree, written once because it is read twice
    counts = stage(degree(edges).groupBy("degree").agg(F.count("*").alias("n")), "degrees")
    mode = counts.agg(F.max(F.struct("n", -F.col("degree"))).alias("m")).scalar()
    is_mode = F.struct("n", (-F.col("degree")).alias("col2")) == mode
    return counts.withColumn("is_mode", is_mode)


def assortativity(edges: DataFrame) -> DataFrame:
    """Degree assortativity (Newman's closed formula) in one aggregate over the edges."""
    d = degree(edges)
    ends = edges.join(d.withColumnsRenamed({"vertex": "src", "degree": "j"}), "src").join(
        d.withColumnsRenamed({"vertex": "dst", "degree": "k"}), "dst"
    )
    j, k = F.col("j").cast("double"), F.col("k").cast("double")
    sums = ends.agg(
        F.count("*").cast("double").alias("m"),
        F.sum(j * k).alias("jk"),
        F.sum(j + k).alias("s1"),
        F.sum(j * j + k * k).alias("s2"),
    )
    mean = F.col("s1") / (2 * F.col("m"))
    return sums.select(
        F.try_divide(
            F.col("jk") / F.col("m") - mean * mean, F.col("s2") / (2 * F.col("m")) - mean * mean
        ).alias("assortativity")
    )


def local_clustering(edges: DataFrame) -> DataFrame:
    """``(vertex, degree, triangles, clustering)``; clustering is 0 below degree 2.

    Every edge points from the end of lower degree to the end of higher degree.  A vertex then has
    at most sqrt(2 m) out-neighbours, even a hub that touches a third of all edges, so the
    out-neighbour arrays are bounded.  Triangles are the intersections of the two arrays at an
    edge; no pairs of neighbours are emitted.  Vertices are named by their place in that order (an int below
    2^31 of them), and an edge takes only the neighbours along that do not come before its higher end.
    """
    d = stage(row_numbers(degree(edges), [], ["degree", "vertex"], "place"), "degree")
    if d.count() < 2**31:
        d = d.withColumn("place", F.col("place").cast("int"))
    ranked = edges.join(d.select(F.col("vertex").alias("src"), F.col("place").alias("ps")), "src").join(
        d.select(F.col("vertex").alias("dst"), F.col("place").alias("pd")), "dst"
    )
    oriented = ranked.select(F.least("ps", "pd").alias("low"), F.greatest("ps", "pd").alias("high"))
    out = stage(oriented.groupBy("low").agg(F.sort_array(F.collect_set("high")).alias("out")), "out")
    hops = out.filter(F.size("out") > 1).select("low", "out", F.posexplode("out").alias("at", "high"))
    hops = hops.select("low", "high", F.slice("out", F.col("at") + 1, F.size("out")).alias("out"))
    # an array per edge is far larger than the file it is unpacked from, by whose size it would be sent through the driver
    ends = hops.hint("merge").join(out.withColumnsRenamed({"low": "high", "out": "out2"}), "high")
    common = ends.select("low", "high", F.array_intersect("out", "out2").alias("common")).filter(
        F.size("common") > 0
    )
    credits = common.select(
        F.inline(
            F.concat(
                F.array(
                    F.struct(F.col("low").alias("place"), F.size("common").cast("bigint").alias("t")),
                    F.struct(F.col("high").alias("place"), F.size("common").cast("bigint").alias("t")),
                ),
                F.transform("common", lambda w: F.struct(w.alias("place"), F.lit(1).cast("bigint").alias("t"))),
            )
        )
    )
    triangles = credits.groupBy("place").agg(F.sum("t").alias("triangles"))
    full = d.join(triangles, "place", "left").select("vertex", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return full.withColumn(
        "clustering", F.coalesce(F.try_divide(F.lit(2.0) * F.col("triangles"), pairs), F.lit(0.0))
    )


def minmax_normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x - min) / (max - min)`` per column; null where the column is constant.

    The bounds are a scalar subquery over ``df``: stage an expensive input first.
    """
    bounds = df.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"lo_{c}") for c in columns],
            *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns],
        ).alias("b")
    ).scalar()
    scaled = {
        c: F.try_divide(
            F.col(c) - bounds.getField(f"lo_{c}"),
            bounds.getField(f"hi_{c}") - bounds.getField(f"lo_{c}"),
        )
        for c in columns
    }
    return df.withColumns(scaled)


def vertex_feature_table(edges: DataFrame, batch: int | None = None) -> DataFrame:
    """The four vertex measures, min-max scaled, one row per vertex."""
    from labelweave.operators.paths import path_measures

    shape = local_clustering(edges).select("vertex", "degree", F.col("clustering").alias("clustering_coefficient"))
    measures = stage(path_measures(edges, batch=batch).join(shape, "vertex"), "measures")
    columns = ["betweenness", "closeness", "degree", "clustering_coefficient"]
    return minmax_normalize(measures.select("vertex", *columns), columns)
