"""Shortest-path measures of undirected networks.

All of them rest on one level-synchronous search from many sources at once.  Its state is a table
keyed by (source, vertex); each round is two equi-joins and one aggregate, staged to the shared
folder.  The state of all sources is vertices x vertices in the worst case, so the sources are
handled in batches, as many as the sizes of the components ask for; the batches together are exact.  Where the state or the work of all sources is too
much there are three ways around it: bounds on eccentricities, which need few searches and stay exact,
sketches of neighbourhoods, and sampled sources with a bound on the error.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.operators.graph import components, vertices
from labelweave.runtime import stage

#: rows that the state of one batch of sources may have
STATE_ROWS = 200_000_000


def _both_ways(edges: DataFrame) -> DataFrame:
    pairs = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return stage(edges.select(F.inline(pairs)).filter("a != b").distinct(), "arcs")


def _levels(arcs: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """One table ``(source, vertex, dist, paths)`` per distance; ``paths`` counts shortest paths."""
    start = sources.select(
        F.col("vertex").alias("source"), "vertex", F.lit(0).alias("dist"), F.lit(1.0).alias("paths")
    )
    levels = [stage(start, "level0")]
    while True:
        frontier = levels[-1]
        dist = len(levels)
        step = (
            frontier.join(arcs, frontier.vertex == arcs.a)
            .groupBy("source", F.col("b").alias("vertex"))
            .agg(F.sum("paths").alias("paths"))
        )
        # In an undirected graph a neighbour of level d lies on level d-1, d or d+1, so only the
        # last two levels need to be excluded, never the whole visited set.
        for seen in levels[-2:]:
            step = step.join(seen.select("source", "vertex"), ["source", "vertex"], "left_anti")
        level = stage(step.select("source", "vertex", F.lit(dist).alias("dist"), "paths"), f"level{dist}")
        if level.isEmpty():
            return levels
        levels.append(level)


def bfs_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Hop counts ``(source, vertex, dist)`` from a set of sources to all reachable vertices."""
    found = _levels(_both_ways(edges), sources.select("vertex").distinct())
    return reduce(DataFrame.unionByName, found).select("source", "vertex", "dist")


def _dependencies(arcs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Sums over sources of each vertex's share in shortest paths and of its square (backward accumulation)."""
    parts = []
    below = None
    for level in reversed(levels[1:]):
        if below is None:
            current = level.withColumn("share", F.lit(0.0))
        else:
            # share of v = sum over its successors w of paths(v) / paths(w) * (1 + share(w))
            sent = (
                below.select("source", "vertex", ((1.0 + F.col("share")) / F.col("paths")).alias("part"))
                .join(arcs, F.col("vertex") == F.col("a"))
                .groupBy("source", F.col("b").alias("vertex"))
                .agg(F.sum("part").alias("part"))
            )
            current = level.join(sent, ["source", "vertex"], "left").select(
                *level.columns, (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")
            )
        below = stage(current, "share")
        parts.append(below.groupBy("vertex").agg(F.sum("share").alias("share"), F.sum(F.col("share") * F.col("share")).alias("squares")))
    if not parts:
        return levels[0].select("vertex", F.lit(0.0).alias("share"), F.lit(0.0).alias("squares"))
    return reduce(DataFrame.unionByName, parts)


def _batches(edges: DataFrame, chosen: DataFrame, n_sources: int, n_vertices: int, batch: int | None) -> list[DataFrame]:
    """The sources in parts of about ``batch``, by default as many as ``STATE_ROWS`` allows.

    A search stays in its component, so the state of a source has at most as many rows as its component has vertices; components are
    asked for only where all sources with all vertices would be too much.
    """
    if batch:
        n_batches = max(1, -(-n_sources // batch))
    elif n_sources * n_vertices <= STATE_ROWS:
        n_batches = 1
    else:
        member = stage(components(edges), "components")
        sizes = member.groupBy("component").agg(F.count("*").alias("size"))
        reach = chosen.join(member, "vertex", "left").join(sizes, "component", "left").agg(F.sum(F.coalesce("size", F.lit(1)))).first()[0]
        n_batches = max(1, -(-(reach or 0) // STATE_ROWS))
    if n_batches == 1:
        return [chosen]
    return [chosen.filter(F.pmod(F.xxhash64("vertex"), F.lit(n_batches)) == i) for i in range(n_batches)]


def path_measures(
    edges: DataFrame,
    batch: int | None = None,
    normalized: bool = False,
    pivots: DataFrame | None = None,
    all_vertices: DataFrame | None = None,
    with_betweenness: bool = True,
) -> DataFrame:
    """``(vertex, betweenness, closeness, eccentricity)`` of every vertex.

    ``closeness`` is 1 / sum of distances over the reachable vertices (times their number when
    ``normalized``), null for an isolated vertex.  ``betweenness`` counts each pair once.
    ``batch`` bounds the number of sources per search (default: what ``STATE_ROWS`` allows); every batch is
    exact, so the result does not depend on it.  With ``pivots`` only those sources are searched and the betweenness is scaled by
    vertices / pivots; closeness is then known for the pivots only.
    """
    arcs = _both_ways(edges)
    every = stage((vertices(edges) if all_vertices is None else all_vertices).select("vertex").distinct(), "vertices")
    chosen = every if pivots is None else stage(pivots.select("vertex").distinct(), "pivots")
    n_vertices = every.count()
    n_sources = n_vertices if pivots is None else chosen.count()
    scale = 1.0 if pivots is None else n_vertices / max(n_sources, 1)
    distances, shares = [], []
    for part in _batches(edges, chosen, n_sources, n_vertices, batch):
        levels = _levels(arcs, part)
        reached = reduce(DataFrame.unionByName, levels)
        distances.append(
            reached.groupBy(F.col("source").alias("vertex")).agg(
                F.sum("dist").alias("total"), F.count_if(F.col("dist") > 0).alias("reached"), F.max("dist").alias("eccentricity")
            )
        )
        if with_betweenness:
            shares.append(_dependencies(arcs, levels))
    distance = reduce(DataFrame.unionByName, distances)
    unit = F.col("reached") if normalized else F.lit(1.0)
    measured = every.join(distance, "vertex", "left").select(
        "vertex", F.try_divide(unit.cast("double"), F.col("total")).alias("closeness"), "eccentricity"
    )
    if not with_betweenness:
        return measured
    share = reduce(DataFrame.unionByName, shares).groupBy("vertex").agg(F.sum("share").alias("share"))
    total = F.coalesce("share", F.lit(0.0)) * (scale / 2)
    return measured.join(share, "vertex", "left").select(
        "vertex", total.alias("betweenness"), "closeness", "eccentricity"
    )


def closeness(edges: DataFrame, batch: int | None = None, normalized: bool = False) -> DataFrame:
    return path_measures(edges, batch, normalized, with_betweenness=False).select("vertex", "closeness")


def betweenness(edges: DataFrame, batch: int | None = None, pivots: DataFrame | None = None) -> DataFrame:
    return path_measures(edges, batch, pivots=pivots).select("vertex", "betweenness")


def eccentricity_bounds(edges: DataFrame, exact: bool = False) -> tuple[DataFrame, int]:
    """``(vertex, component, low, high)`` around every eccentricity, and the number of searches made.

    A search bounds the eccentricity of every vertex of its component: with ``d`` the distance to the source and ``e`` the
    source's eccentricity it lies between max(d, e - d) and e + d.  Before any search it is at most the component's size less the
    vertex's number of neighbours.  A round searches from the vertices with the highest upper and the lowest lower bound of every component that is
    not settled.  The rounds end when no upper bound exceeds the largest lower one, which then is the diameter, or with
    ``exact`` when all bounds have met.  The state of a round is two rows per vertex; only two numbers come to the driver.
    """
    arcs = _both_ways(edges)
    member = stage(components(edges), "components")
    size = member.groupBy("component").agg(F.count("*").alias("size"))
    near = arcs.groupBy(F.col("a").alias("vertex")).agg(F.count("*").alias("degree"))
    alone = F.col("degree").isNull()
    state = stage(
        member.join(size, "component")
        .join(near, "vertex", "left")
        .select(
            "vertex",
            "component",
            F.coalesce("degree", F.lit(0)).alias("degree"),
            F.when(alone, 0).otherwise(1).alias("low"),
            F.when(alone, 0).otherwise((F.col("size") - F.col("degree")).cast("int")).alias("high"),
        ),
        "bounds",
    )
    longest, searches = state.agg(F.max("low")).first()[0], 0
    while True:
        unsettled = state.filter(F.col("low") < F.col("high")) if exact else state.filter(F.col("high") > longest)
        ends = unsettled.groupBy("component").agg(
            F.max(F.struct("high", "degree", "vertex")).alias("far"), F.max(F.struct(-F.col("low"), "degree", "vertex")).alias("mid")
        )
        sources = stage(ends.select(F.explode(F.array("far.vertex", "mid.vertex")).alias("vertex")).distinct(), "sources")
        n_sources = sources.count()
        if n_sources == 0:
            return state.drop("degree"), searches
        searches += n_sources
        found = reduce(DataFrame.unionByName, _levels(arcs, sources)).select("source", "vertex", "dist")
        depth = found.groupBy("source").agg(F.max("dist").alias("ecc"))
        news = (
            found.join(depth, "source")
            .groupBy("vertex")
            .agg(F.max(F.greatest("dist", F.col("ecc") - F.col("dist"))).alias("above"), F.min(F.col("ecc") + F.col("dist")).alias("below"))
        )
        state = stage(
            state.join(news, "vertex", "left").select(
                "vertex", "component", "degree", F.greatest("low", "above").alias("low"), F.least("high", "below").alias("high")
            ),
            "bounds",
        )
        longest = state.agg(F.max("low")).first()[0]


def eccentricities(edges: DataFrame) -> DataFrame:
    """``(vertex, eccentricity)`` within the components, exact, by as many searches as the bounds need."""
    return eccentricity_bounds(edges, exact=True)[0].select("vertex", F.col("low").alias("eccentricity"))


def diameter(edges: DataFrame) -> DataFrame:
    """Longest shortest path within the components (null without vertices), exact, by few searches."""
    return eccentricity_bounds(edges)[0].agg(F.max("low").alias("diameter"))


def closeness_sketch(edges: DataFrame, precision: int = 12) -> DataFrame:
    """``(vertex, closeness, reached, total)`` from sketches of neighbourhoods instead of searches.

    Every vertex holds a HyperLogLog sketch (2 ** ``precision`` registers) of the vertices within ``t`` steps; step ``t + 1``
    unites it with those of its neighbours, and the growth of its estimate counts the vertices at that distance.  The state is one
    sketch per vertex, and only vertices whose sketch grew send it on.  Neighbourhoods that a sparse sketch holds (some hundred vertices)
    are counted exactly; beyond that the relative error of a count is about 1.04 / sqrt(2 ** precision).
    """
    arcs = _both_ways(edges)
    state = stage(
        vertices(edges)
        .groupBy("vertex")
        .agg(F.hll_sketch_agg("vertex", precision).alias("sketch"))
        .select("vertex", "sketch", F.lit(1).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("total"), F.lit(True).alias("grew")),
        "sketches",
    )
    step = 0
    while not state.filter("grew").isEmpty():
        step += 1
        sent = (
            state.filter("grew")
            .join(arcs, F.col("vertex") == F.col("a"))
            .groupBy(F.col("b").alias("vertex"))
            .agg(F.hll_union_agg("sketch").alias("sent"))
        )
        united = state.join(sent, "vertex", "left").select(
            "vertex", F.coalesce(F.hll_union("sketch", "sent"), "sketch").alias("sketch"), "size", "total"
        )
        now = F.greatest(F.hll_sketch_estimate("sketch"), F.col("size"))
        state = stage(
            united.withColumn("now", now).select(
                "vertex",
                "sketch",
                F.col("now").alias("size"),
                (F.col("total") + step * (F.col("now") - F.col("size"))).alias("total"),
                (F.col("now") > F.col("size")).alias("grew"),
            ),
            "sketches",
        )
    return state.select("vertex", F.try_divide(F.lit(1.0), F.col("total")).alias("closeness"), (F.col("size") - 1).alias("reached"), "total")


def betweenness_sampled(
    edges: DataFrame, epsilon: float = 0.01, confidence: float = 0.9, first: int = 256, batch: int | None = None, seed: int = 42
) -> DataFrame:
    """``(vertex, betweenness, error)`` from sampled sources, as many as the wanted error needs.

    ``betweenness`` counts pairs as ``betweenness`` does.  With probability ``confidence`` all vertices at once are off by at most
    their ``error``, and no ``error`` exceeds ``epsilon`` times the (n - 1)(n - 2) / 2 pairs.  Sources are drawn without replacement by a hash and doubled until
    an empirical Bernstein bound for such draws holds at every vertex; a vertex's share in the paths of one source, over n - 2,
    lies between 0 and 1.  Once all vertices are sources the result is exact and ``error`` is 0.
    """
    arcs = _both_ways(edges)
    every = stage(vertices(edges), "vertices")
    n = every.count()
    place = F.pmod(F.xxhash64("vertex", F.lit(seed)), F.lit(2**31)) / 2**31
    rounds = 1 + max(0, math.ceil(math.log2(max(n, 1) / first)))
    # the bound holds for both sides of every vertex in every round
    log_term = math.log(10 * max(n, 1) * rounds / (1 - confidence))
    kappa = 7 / 3 + 3 / math.sqrt(2)
    range_ = max(n - 2, 1)
    sums = every.select("vertex", F.lit(0.0).alias("share"), F.lit(0.0).alias("squares"))
    drawn, low = 0, 0.0
    for i in range(rounds):
        high = 1.0 if i == rounds - 1 else min(1.0, first * 2**i / n)
        chosen = stage(every.filter((place >= low) & (place < high)), "sources")
        n_chosen = chosen.count()
        parts = [_dependencies(arcs, _levels(arcs, part)) for part in _batches(edges, chosen, n_chosen, n, batch)]
        united = reduce(DataFrame.unionByName, [sums, *parts])
        sums = stage(united.groupBy("vertex").agg(F.sum("share").alias("share"), F.sum("squares").alias("squares")), "shares")
        drawn, low = drawn + n_chosen, high
        if drawn == n:
            error = F.lit(0.0)
            break
        if drawn == 0:
            continue
        unseen = 1 - (drawn - 1) / n if drawn <= n / 2 else (1 - drawn / n) * (1 + 1 / drawn)
        mean = F.col("share") / (drawn * range_)
        variance = F.greatest(F.col("squares") / (drawn * range_**2) - mean * mean, F.lit(0.0))
        error = F.sqrt(variance * (2 * unseen * log_term / drawn)) + kappa * log_term / drawn
        # the mean over n sources, in shares of the pairs without the vertex
        if sums.agg(F.max(error)).first()[0] * n / (n - 1) <= epsilon:
            break
    return sums.select(
        "vertex", (F.col("share") * (n / (2 * max(drawn, 1)))).alias("betweenness"), (error * (n * range_ / 2)).alias("error")
    )
