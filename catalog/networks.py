"""Network queries.

The line item network (part and supplier numbers in one vertex space) has hub vertices; the
conversation network has many small components for the path measures, which need all sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import EDGES, RAW_EDGES, TURN_EDGES, as_long, query, rounded, rows, table, with_inputs
from labelweave.operators import clean, graph, paths
from labelweave.plans.networks import network_dataset as build_dataset
from labelweave.runtime import stage

DEGREE = "SELECT vertex, count(*) AS degree FROM (SELECT src AS vertex FROM e UNION ALL SELECT dst FROM e) GROUP BY vertex"


def edges_of(spark, folder):
    """The cleaned network, written once: every measure reads it several times."""
    return stage(graph.dedupe_edges(clean.drop_self_loops(rows(spark, folder, RAW_EDGES))), "edges")


@query("canonicalize_edges", with_inputs("SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM e", e=RAW_EDGES))
def canonicalize_edges(spark, folder):
    return graph.canonicalize_edges(rows(spark, folder, RAW_EDGES))


@query("dedupe_edges", with_inputs("SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e", e=RAW_EDGES))
def dedupe_edges(spark, folder):
    return graph.dedupe_edges(rows(spark, folder, RAW_EDGES))


@query("vertices", with_inputs("SELECT src AS vertex FROM e UNION SELECT dst FROM e", e=RAW_EDGES))
def vertices(spark, folder):
    return graph.vertices(rows(spark, folder, RAW_EDGES))


@query(
    "edge_key_collisions",
    with_inputs(
        "SELECT CAST(src AS VARCHAR) || CAST(dst AS VARCHAR) AS edge_key, count(*) AS n_pairs FROM e GROUP BY 1 HAVING count(*) > 1", e=EDGES
    ),
)
def edge_key_collisions(spark, folder):
    return graph.edge_key_collisions(clean.drop_self_loops(rows(spark, folder, RAW_EDGES)))


FLAG_EDGES = {f: f"SELECT l_partkey AS src, l_suppkey AS dst FROM {{lineitem}} WHERE l_returnflag = '{f}'" for f in "ANR"}


@query(
    "union_networks",
    with_inputs(
        """SELECT src, dst, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM
        (SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, l_returnflag AS source FROM lineitem) GROUP BY src, dst""",
        e="SELECT 1",
    ),
)
def union_networks(spark, folder):
    united = graph.union_networks({f: rows(spark, folder, t) for f, t in FLAG_EDGES.items()})
    return united.withColumn("sources", F.array_join("sources", ","))


@query(
    "induced_subgraph",
    with_inputs(
        "SELECT src, dst FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 10) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 10)",
        e=EDGES,
    ),
)
def induced_subgraph(spark, folder):
    keep = table(spark, folder, "part").filter("p_size > 10").select(F.col("p_partkey").alias("vertex"))
    return graph.induced_subgraph(edges_of(spark, folder), keep)


@query("degree", with_inputs("SELECT * FROM d", e=EDGES, d=DEGREE))
def degree(spark, folder):
    return graph.degree(edges_of(spark, folder))


@query(
    "graph_summary",
    with_inputs(
        """SELECT n_vertices, n_edges, round(2.0::DOUBLE * n_edges / (n_vertices * (n_vertices - 1)), 9) AS density
        FROM (SELECT (SELECT count(*) FROM d) AS n_vertices, (SELECT count(*) FROM e) AS n_edges)""",
        e=EDGES,
        d=DEGREE,
    ),
)
def graph_summary(spark, folder):
    return rounded(graph.graph_summary(edges_of(spark, folder)), 9)


@query(
    "degree_stats",
    with_inputs(
        """SELECT round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree,
        (SELECT min(vertex) FROM d WHERE degree = (SELECT max(degree) FROM d)) AS max_vertex FROM d""",
        e=EDGES,
        d=DEGREE,
    ),
)
def degree_stats(spark, folder):
    return rounded(graph.degree_stats(edges_of(spark, folder)))


@query(
    "degree_distribution",
    with_inputs(
        "SELECT degree, n, row_number() OVER (ORDER BY n DESC, degree) = 1 AS is_mode FROM (SELECT degree, count(*) AS n FROM d GROUP BY degree)",
        e=EDGES,
        d=DEGREE,
    ),
)
def degree_distribution(spark, folder):
    return graph.degree_distribution(edges_of(spark, folder))


@query(
    "assortativity",
    with_inputs(
        """SELECT round((sum(j * k)::DOUBLE / count(*) - pow(sum(j + k)::DOUBLE / (2 * count(*)), 2)) /
        (sum(j * j + k * k)::DOUBLE / (2 * count(*)) - pow(sum(j + k)::DOUBLE / (2 * count(*)), 2)), 6) AS assortativity
        FROM (SELECT a.degree AS j, b.degree AS k FROM e JOIN d a ON e.src = a.vertex JOIN d b ON e.dst = b.vertex)""",
        e=EDGES,
        d=DEGREE,
    ),
)
def assortativity(spark, folder):
    return rounded(graph.assortativity(edges_of(spark, folder)))


TRIANGLES = """SELECT unnest([x.src, x.dst, y.dst]) AS vertex FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst"""
CLUSTERING = """SELECT d.vertex, d.degree, coalesce(t.n, 0)::BIGINT AS triangles,
round(CASE WHEN d.degree < 2 THEN 0 ELSE 2.0::DOUBLE * coalesce(t.n, 0) / (d.degree * (d.degree - 1)) END, 6) AS clustering
FROM d LEFT JOIN (SELECT vertex, count(*) AS n FROM tri GROUP BY vertex) t ON d.vertex = t.vertex"""


@query("local_clustering", with_inputs("SELECT * FROM c", e=EDGES, d=DEGREE, tri=TRIANGLES, c=CLUSTERING))
def local_clustering(spark, folder):
    return rounded(as_long(graph.local_clustering(edges_of(spark, folder)), "triangles"))


@query(
    "minmax_normalize",
    with_inputs(
        "SELECT vertex, round((degree - min(degree) OVER ())::DOUBLE / (max(degree) OVER () - min(degree) OVER ()), 6) AS degree FROM d",
        e=EDGES,
        d=DEGREE,
    ),
)
def minmax_normalize(spark, folder):
    return rounded(graph.minmax_normalize(graph.degree(edges_of(spark, folder)), ["degree"]))


# ---------------------------------------------------------------- paths

PATH_INPUTS = {
    "e": TURN_EDGES,
    "arcs": "SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e",
    "walks": "SELECT DISTINCT a AS source, a AS vertex, 0 AS dist FROM arcs UNION SELECT w.source, arcs.b, w.dist + 1 FROM walks w JOIN arcs ON w.vertex = arcs.a WHERE w.dist < 12",
    "dist": "SELECT source, vertex, min(dist)::INT AS dist FROM walks GROUP BY source, vertex",
    "routes": """SELECT DISTINCT a AS source, a AS vertex, 0 AS dist FROM arcs UNION ALL
SELECT r.source, arcs.b, r.dist + 1 FROM routes r JOIN arcs ON r.vertex = arcs.a
JOIN dist x ON x.source = r.source AND x.vertex = arcs.b AND x.dist = r.dist + 1""",
    "sigma": "SELECT r.source, r.vertex, any_value(r.dist) AS dist, count(*) AS paths FROM routes r GROUP BY r.source, r.vertex",
    "between": """SELECT v.vertex, sum(v.paths * w.paths / t.paths) / 2 AS betweenness
FROM sigma v JOIN sigma w ON v.vertex = w.source JOIN sigma t ON t.source = v.source AND t.vertex = w.vertex
WHERE v.dist > 0 AND w.dist > 0 AND v.dist + w.dist = t.dist GROUP BY v.vertex""",
    "close": "SELECT source AS vertex, 1.0::DOUBLE / sum(dist) AS closeness, max(dist) AS eccentricity FROM dist GROUP BY source",
}


def turns(spark, folder):
    return rows(spark, folder, TURN_EDGES)


@query(
    "bfs_distances",
    with_inputs("SELECT source, vertex, dist FROM dist WHERE source % 100000000 = 0", **{k: PATH_INPUTS[k] for k in ("e", "arcs", "walks", "dist")}),
)
def bfs_distances(spark, folder):
    opening = table(spark, folder, "conversations").filter("turn = 0").select((F.col("conv_id") * 100000000).alias("vertex"))
    edges = stage(turns(spark, folder), "edges")
    starts = opening.join(graph.vertices(edges), "vertex", "left_semi")
    return paths.bfs_distances(edges, starts)


@query("closeness", with_inputs("SELECT vertex, round(closeness, 6) AS closeness FROM close", **{k: PATH_INPUTS[k] for k in ("e", "arcs", "walks", "dist", "close")}))
def closeness(spark, folder):
    return rounded(paths.closeness(turns(spark, folder)))


@query("diameter", with_inputs("SELECT max(dist) AS diameter FROM dist", **{k: PATH_INPUTS[k] for k in ("e", "arcs", "walks", "dist")}))
def diameter(spark, folder):
    return paths.diameter(stage(turns(spark, folder), "edges"))


@query(
    "eccentricities",
    with_inputs("SELECT vertex, eccentricity FROM close", **{k: PATH_INPUTS[k] for k in ("e", "arcs", "walks", "dist", "close")}),
)
def eccentricities(spark, folder):
    return paths.eccentricities(stage(turns(spark, folder), "edges"))


@query(
    "closeness_sketch",
    with_inputs(
        "SELECT vertex, round(closeness, 6) AS closeness, reached, total FROM (SELECT source AS vertex, 1.0::DOUBLE / sum(dist) AS closeness, count(*) - 1 AS reached, sum(dist)::BIGINT AS total FROM dist GROUP BY source)",
        **{k: PATH_INPUTS[k] for k in ("e", "arcs", "walks", "dist")},
    ),
)
def closeness_sketch(spark, folder):
    return rounded(paths.closeness_sketch(stage(turns(spark, folder), "edges")))


@query("components", with_inputs("SELECT vertex, min(source) AS component FROM dist GROUP BY vertex", **{k: PATH_INPUTS[k] for k in ("e", "arcs", "walks", "dist")}))
def components(spark, folder):
    return graph.components(stage(turns(spark, folder), "edges"))


@query(
    "betweenness",
    with_inputs(
        "SELECT s.vertex, round(coalesce(b.betweenness, 0), 6) AS betweenness FROM close s LEFT JOIN between b ON s.vertex = b.vertex", **PATH_INPUTS
    ),
)
def betweenness(spark, folder):
    return rounded(paths.betweenness(turns(spark, folder)))


@query("betweenness_sampled")
def betweenness_sampled(spark, folder):
    # no SQL text: the sample is beyond it, tests hold values and bounds against exact ones
    return rounded(paths.betweenness_sampled(stage(turns(spark, folder), "edges"), epsilon=0.05))


@query(
    "vertex_feature_table",
    with_inputs(
        """SELECT vertex, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS betweenness,
        round((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 6) AS closeness,
        round((degree - min(degree) OVER ())::DOUBLE / (max(degree) OVER () - min(degree) OVER ()), 6) AS degree,
        round((k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()), 6) AS clustering_coefficient
        FROM (SELECT s.vertex, coalesce(b.betweenness, 0) AS b, s.closeness AS c, cl.degree, cl.clustering AS k
              FROM close s LEFT JOIN between b ON s.vertex = b.vertex JOIN cl ON cl.vertex = s.vertex)""",
        **PATH_INPUTS,
        d=DEGREE,
        tri=TRIANGLES,
        cl=CLUSTERING.replace("round(", "(").replace(", 6)", ")"),
    ),
)
def vertex_feature_table(spark, folder):
    return rounded(graph.vertex_feature_table(stage(turns(spark, folder), "edges")))


#: the two kinds of turn edges as separate networks, and a dictionary that changes nothing
TURN_NETWORKS = {
    "time": "SELECT conv_id * 100000000 + turn - 1 AS src, conv_id * 100000000 + turn AS dst FROM {conversations} WHERE turn > 0",
    "reply": "SELECT conv_id * 100000000 AS src, conv_id * 100000000 + turn AS dst FROM {conversations} WHERE turn > 0 AND role = 'assistant'",
}
TURN_ROWS = "SELECT conv_id * 100000000 + turn AS vertex, length(text) AS n_chars, role FROM {conversations}"


@query(
    "network_dataset",
    with_inputs(
        """SELECT s.vertex, round((coalesce(b.betweenness, 0) - bmin) / (bmax - bmin), 6) AS betweenness, t.n_chars, t.role
        FROM close s LEFT JOIN between b ON s.vertex = b.vertex LEFT JOIN turns t ON t.vertex = s.vertex,
        (SELECT min(coalesce(b.betweenness, 0)) AS bmin, max(coalesce(b.betweenness, 0)) AS bmax FROM close s LEFT JOIN between b ON s.vertex = b.vertex)""",
        **PATH_INPUTS,
        turns="SELECT vertex, n_chars::INT AS n_chars, role FROM (" + TURN_ROWS + ")",
    ),
)
def network_dataset(spark, folder):
    networks = {name: rows(spark, folder, text) for name, text in TURN_NETWORKS.items()}
    turn_rows = rows(spark, folder, TURN_ROWS)
    names = turn_rows.select(F.col("vertex").alias("input"), F.col("vertex").alias("approved"))
    out = build_dataset(networks, names, turn_rows.select("vertex", "n_chars"), turn_rows.select("vertex", "role"))
    return rounded(out.select("vertex", "betweenness", "n_chars", "role"))
