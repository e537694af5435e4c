"""Networks against brute force."""

from __future__ import annotations

import itertools
import random
from collections import deque

import pytest

from labelweave.operators import graph, paths

GRAPHS = {
    "path": [(1, 2), (2, 3), (3, 4)],
    "star": [(1, i) for i in range(2, 7)],
    "triangle with pendant": [(1, 2), (2, 3), (1, 3), (3, 4)],
    "two components": [(1, 2), (2, 3), (10, 11)],
}
rng = random.Random(3)
GRAPHS["random"] = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(26)})


def _neighbors(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def _bfs(near, s):
    dist, paths_, queue = {s: 0}, {s: 1}, deque([s])
    while queue:
        v = queue.popleft()
        for w in near[v]:
            if w not in dist:
                dist[w], paths_[w] = dist[v] + 1, 0
                queue.append(w)
            if dist[w] == dist[v] + 1:
                paths_[w] += paths_[v]
    return dist, paths_


def _brute(edges):
    near = _neighbors(edges)
    found = {s: _bfs(near, s) for s in near}
    out = {}
    for v in near:
        share = 0.0
        for s, t in itertools.combinations(near, 2):
            if v in (s, t) or t not in found[s][0] or v not in found[s][0]:
                continue
            if found[s][0][v] + found[v][0][t] == found[s][0][t]:
                share += found[s][1][v] * found[v][1][t] / found[s][1][t]
        total = sum(found[v][0].values())
        out[v] = (share, 1 / total, max(found[v][0].values()))
    return out


@pytest.mark.parametrize("name,batch", [*[(n, None) for n in GRAPHS], ("random", 6)])
def test_path_measures(spark, name, batch):
    edges = spark.createDataFrame(GRAPHS[name], "src INT, dst INT")
    expected = _brute(GRAPHS[name])
    got = {r.vertex: r for r in paths.path_measures(edges, batch=batch).collect()}
    assert set(got) == set(expected)
    for v, (share, close, ecc) in expected.items():
        assert got[v].betweenness == pytest.approx(share)
        assert got[v].closeness == pytest.approx(close)
        assert got[v].eccentricity == ecc


def test_isolated_vertices_and_pivots(spark):
    edges = spark.createDataFrame(GRAPHS["path"], "src INT, dst INT")
    every = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 99)], "vertex INT")
    got = {r.vertex: r for r in paths.path_measures(edges, all_vertices=every).collect()}
    assert got[99].closeness is None and got[99].betweenness == 0
    all_pivots = {r.vertex: r.betweenness for r in paths.betweenness(edges, pivots=graph.vertices(edges)).collect()}
    assert all_pivots[2] == pytest.approx(2.0)


@pytest.mark.parametrize("name", GRAPHS)
def test_local_clustering(spark, name):
    near = _neighbors(GRAPHS[name])
    edges = spark.createDataFrame(GRAPHS[name], "src INT, dst INT")
    for r in graph.local_clustering(edges).collect():
        links = sum(1 for a, b in itertools.combinations(near[r.vertex], 2) if b in near[a])
        d = len(near[r.vertex])
        assert r.triangles == links
        assert r.clustering == pytest.approx(2 * links / (d * (d - 1)) if d > 1 else 0)


def test_cleaning_of_networks(spark):
    raw = spark.createDataFrame([("A", "BC"), ("AB", "C"), ("BC", "A"), ("x", "x")], "src STRING, dst STRING")
    clean = graph.dedupe_edges(raw.filter("src <> dst"))
    assert clean.count() == 2
    collisions = graph.edge_key_collisions(clean).collect()
    assert [(r.edge_key, r.n_pairs) for r in collisions] == [("ABC", 2)]
    united = graph.union_networks({"one": raw, "two": raw.limit(1)})
    assert {tuple(r.sources) for r in united.filter("src = 'A'").collect()} == {("one", "two")}


def test_degree_statistics(spark):
    edges = spark.createDataFrame(GRAPHS["star"], "src INT, dst INT")
    stats = graph.degree_stats(edges).first()
    assert (stats.max_degree, stats.max_vertex) == (5, 1)
    modes = graph.degree_distribution(edges).filter("is_mode").collect()
    assert [(r.degree, r.n) for r in modes] == [(1, 5)]
    assert graph.assortativity(edges).first()[0] == pytest.approx(-1.0)
    summary = graph.graph_summary(edges).first()
    assert (summary.n_vertices, summary.n_edges) == (6, 5)


@pytest.mark.parametrize("name", ["triangle with pendant", "two components"])
def test_components_and_eccentricities(spark, name):
    near = _neighbors(GRAPHS[name])
    edges = spark.createDataFrame([*GRAPHS[name], (90, 90)], "src INT, dst INT")
    roots = {v: min(_bfs(near, v)[0]) for v in near} | {90: 90}
    assert {r.vertex: r.component for r in graph.components(edges).collect()} == roots
    depths = {v: max(_bfs(near, v)[0].values()) for v in near} | {90: 0}
    assert {r.vertex: r.eccentricity for r in paths.eccentricities(edges).collect()} == depths
    assert paths.diameter(edges).first().diameter == max(depths.values())


def _large_graph(n: int, extra: int, seed: int):
    """A hub, a long tail and random links among ``n`` vertices."""
    draw = random.Random(seed)
    tree = {(draw.randrange(max(0, v - 40), v), v) for v in range(1, n)}
    return sorted(tree | {tuple(sorted(draw.sample(range(n), 2))) for _ in range(extra)} | {(0, v) for v in range(1, n, 9)})


def test_diameter_by_few_searches(spark):
    pairs = _large_graph(300, 30, 5)
    near = _neighbors(pairs)
    bounds, searches = paths.eccentricity_bounds(spark.createDataFrame(pairs, "src INT, dst INT"))
    assert bounds.agg({"low": "max"}).first()[0] == max(max(_bfs(near, v)[0].values()) for v in near)
    assert searches <= 40


def test_diameter_without_edges(spark):
    assert paths.diameter(spark.createDataFrame([], "src INT, dst INT")).first().diameter is None


def test_closeness_sketch_error(spark):
    pairs = _large_graph(1500, 900, 6)
    near = _neighbors(pairs)
    got = paths.closeness_sketch(spark.createDataFrame([*pairs, (9000, 9001)], "src INT, dst INT")).collect()
    exact = {v: 1 / sum(_bfs(near, v)[0].values()) for v in near} | {9000: 1.0, 9001: 1.0}
    errors = sorted(abs(r.closeness / exact[r.vertex] - 1) for r in got)
    assert len(got) == len(exact)
    assert errors[int(0.95 * len(errors))] <= 0.05 and sum(errors) / len(errors) <= 0.03


def _accumulated(near):
    """Betweenness of every vertex, counted from each source in turn."""
    total = dict.fromkeys(near, 0.0)
    for s in near:
        dist, routes = _bfs(near, s)
        share = dict.fromkeys(dist, 0.0)
        for w in sorted(dist, key=dist.get, reverse=True):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += routes[v] / routes[w] * (1 + share[w])
            if w != s:
                total[w] += share[w] / 2
    return total


@pytest.mark.parametrize("epsilon,sampled", [(0.08, True), (0.0001, False)])
def test_sampled_betweenness_keeps_its_bound(spark, epsilon, sampled):
    n = 1600 if sampled else 150
    pairs = _large_graph(n, n // 3, 7)
    exact = _accumulated(_neighbors(pairs))
    got = paths.betweenness_sampled(spark.createDataFrame(pairs, "src INT, dst INT"), epsilon, 0.9, first=100 if not sampled else 700).collect()
    assert len(got) == len(exact)
    for r in got:
        assert abs(r.betweenness - exact[r.vertex]) <= r.error + 1e-6 * (1 + exact[r.vertex])
        assert r.error <= epsilon * (n - 1) * (n - 2) / 2 * 1.0001
    assert any(r.error > 0 for r in got) == sampled


def test_many_small_components_are_one_batch(spark, monkeypatch):
    """The state of a search ends with its component, so 40 paths of three vertices are 360 rows, not 120 x 120."""
    edges = spark.createDataFrame([(10 * i + j, 10 * i + j + 1) for i in range(40) for j in range(2)], "src long, dst long")
    searches = []
    levels = paths._levels
    monkeypatch.setattr(paths, "STATE_ROWS", 400)
    monkeypatch.setattr(paths, "_levels", lambda arcs, sources: searches.append(1) or levels(arcs, sources))
    got = {r.vertex: (r.betweenness, r.closeness, r.eccentricity) for r in paths.path_measures(edges).collect()}
    assert len(searches) == 1
    ends, middle = (0.0, 1 / 3, 2), (1.0, 1 / 2, 1)
    assert got == {10 * i + j: middle if j == 1 else ends for i in range(40) for j in range(3)}


def test_local_clustering_sends_places_and_no_lower_neighbours(spark, monkeypatch):
    rng = random.Random(4)
    big = 10**15
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(250)}
    staged, stage = {}, graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    got = {r.vertex - big: r for r in graph.local_clustering(spark.createDataFrame([(a + big, b + big) for a, b in pairs], "src bigint, dst bigint")).collect()}
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for p in pairs for v in p}
    for v, others in near.items():
        triangles = sum((a, b) in pairs for a in others for b in others)
        assert (got[v].degree, got[v].triangles) == (len(others), triangles)
    assert len(got) == len(near)
    # ids are long, places are not; in their order the neighbours along an edge are a tail of the array
    assert dict(staged["out"].dtypes) == {"low": "int", "out": "array<int>"}
    assert all(r.out == sorted(r.out) and r.low < r.out[0] for r in staged["out"].collect())
