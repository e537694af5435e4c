"""A forest of regression trees on a table of any length.

Features are cut into bins, and equal rows become one row with their number.  A level of all trees takes one pass: each task draws its rows' bootstrap
counts anew, adds rows of the same bins up, and sums weights and scores per (tree, feature, node, bin); the sums of the tasks are added and the best
split of every node is chosen from them.  What a pass shuffles depends on trees, nodes and bins, not on the rows.

Bootstrap counts are Poisson draws by hashes of (seed, tree, row), so they don't depend on how rows are partitioned, and a retried task repeats them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.learning.trees import PLACES, binned, draws, matrix_of
from labelweave.runtime import stage

#: Rows that a task of a pass looks at together, and those it draws together, so that their arrays stay near the processor.
CHUNK, BLOCK = 1 << 17, 1 << 13
#: Parts of (0, 1) for which counts are looked up.
PARTS = 1 << 12


def feature_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Where each of the ``values`` is cut: between all neighbouring values where there are at most ``bins`` of them, else at quantiles."""
    at = [F.element_at("values", f + 1) for f in range(width)]
    places = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    seen = rows.agg(*[F.approx_count_distinct(v).alias(f"n{f}") for f, v in enumerate(at)], *[F.percentile_approx(v, places, F.lit(10_000)).alias(f"q{f}") for f, v in enumerate(at)]).first()
    edges = [np.unique(np.array(seen[f"q{f}"] or [], float)) for f in range(width)]
    few = [f for f in range(width) if seen[f"n{f}"] <= 2 * bins]
    if few:
        sets = rows.agg(*[F.collect_set(at[f]).alias(f"s{f}") for f in few]).first()
        for f in few:
            values = np.unique(np.array(sets[f"s{f}"], float))
            if len(values) <= bins:
                edges[f] = (values[:-1] + values[1:]) / 2
    return edges


@lru_cache(maxsize=1024)
def _steps(mean: int) -> tuple[int, np.ndarray]:
    """The smallest count that occurs, and the cumulative shares from it on, of a Poisson variable."""
    reach = 12 * math.sqrt(mean) + 30
    low, high = max(0, int(mean - reach)), int(mean + reach)
    k = np.arange(low, high + 1, dtype=float)
    logs = k * math.log(mean) - mean - math.lgamma(low + 1) - np.concatenate([[0.0], np.log(k[1:]).cumsum()])
    return low, np.exp(logs).cumsum()


@lru_cache(maxsize=1)
def _single() -> np.ndarray:
    """The count of mean 1 for each part of (0, 1); -1 for parts in which it changes."""
    counts = np.searchsorted(_steps(1)[1], np.arange(PARTS + 1) / PARTS)
    return np.where(counts[:-1] == counts[1:], counts[:-1], -1).astype(float)


def bootstrap_counts(u: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """How often a bootstrap draws each row, given even numbers: rows that stand for ``n`` copies are drawn as often as ``n`` rows together."""
    out = _single()[(u * PARTS).astype(np.int64)]
    unsure = np.flatnonzero(out < 0)
    out[unsure] = np.searchsorted(_steps(1)[1], u[unsure])
    # the sum of n Poisson counts of mean 1 is one of mean n
    for n in np.unique(copies[copies > 1]).tolist() if copies.max(initial=0) > 1 else ():
        own = copies == n
        low, steps = _steps(n)
        out[own] = low + np.searchsorted(steps, u[own])
    return out


def _nodes_of(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """The node of ``level`` in which each row lies, counted from the level's first; negative where the tree has ended before."""
    node = np.zeros(len(x), np.int64)
    start = np.arange(len(x)) * x.shape[1]
    flat = x.ravel()
    for _ in range(level):
        f = feature[node]
        child = 2 * node + 1 + (flat[start + np.maximum(f, 0)] > cut[node])
        # the place after the last node stands for rows of ended branches
        node = np.where(f < 0, len(feature) - 1, child)
    node -= (1 << level) - 1
    return np.where(node < 1 << level, node, -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _sums(batches: Iterator[pa.RecordBatch], feature: np.ndarray, cut: np.ndarray, level: int, sizes: Sequence[int], seed: int, mean: float) -> Iterator[pa.RecordBatch]:
    """Weights and weighted scores of a task's rows per (tree, feature), by node and bin."""
    trees, width, nodes = len(feature), len(sizes), 1 << level
    held = [[np.zeros((2, nodes * b)) for b in sizes] for _ in range(trees)]
    some = False
    for table in _chunks(batches):
        if not table.num_rows:
            continue
        some = True
        cells = np.frombuffer(b"".join(table.column("cell").to_pylist()), np.uint8).reshape(-1, width)
        score, copies, rows = (table.column(c).to_numpy() for c in ("score", "n", "row"))
        # rows of the same bins lie together, as each file is sorted by them
        first = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(1)]))
        x, score = cells[first], score - mean
        for t in range(trees):
            weight = np.concatenate([bootstrap_counts(draws(seed, 1, t, rows[i : i + BLOCK]), copies[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)])
            w, s = np.add.reduceat(weight, first), np.add.reduceat(weight * score, first)
            node = _nodes_of(x, feature[t], cut[t], level)
            use = np.flatnonzero((node >= 0) & (w > 0))
            node, w, s, own = node[use], w[use], s[use], x[use]
            for f, b in enumerate(sizes):
                index = node * b + own[:, f]
                held[t][f][0] += np.bincount(index, w, nodes * b)
                held[t][f][1] += np.bincount(index, s, nodes * b)
    if some:
        for t in range(trees):
            sums = pa.array([h.ravel() for h in held[t]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([t * width + f for f in range(width)], pa.int32()), sums], names=["at", "sums"])


def best_cuts(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sums ``(2, nodes, bins)``: each node's gain in explained squares, cut, and the sums left of the cut and of the node."""
    left, total = sums.cumsum(2)[:, :, :-1], sums.sum(2)
    right = total[:, :, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = left[1] ** 2 / left[0] + right[1] ** 2 / right[0]
        whole = np.where(total[0] > 0, total[1] ** 2 / total[0], 0.0)
        gain = np.where((left[0] > 0) & (right[0] > 0), parts - whole[:, None], -np.inf)
        # what rounding leaves is no gain
        gain = np.where(gain > 1e-11 * parts, gain, -np.inf)
    if not gain.shape[1]:
        return np.full(len(gain), -np.inf), np.zeros(len(gain), np.int64), np.zeros_like(total), total
    # gains that are equal up to rounding go to the first cut
    top = gain.max(1, keepdims=True)
    cut = (gain >= top * (1 - 10.0**-PLACES)).argmax(1)
    each = np.arange(len(gain))
    return gain[each, cut], cut, left[:, each, cut], total


def _chosen(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Adds the tasks' sums up and gives the best cut of every node by one feature; rows come sorted by ``at``."""

    def cuts(at: int, sums: np.ndarray) -> pa.RecordBatch:
        gain, cut, left, total = best_cuts(sums.reshape(2, 1 << level, -1))
        columns = [[at], *[[np.asarray(c, float)] for c in (gain, cut, *left, *total)]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.list_(pa.float64())) for c in columns[1:]]], names=["at", *CHOSEN])

    now, sums = -1, np.empty(0)
    for batch in batches:
        found = batch.column("sums")
        for i, at in enumerate(batch.column("at").to_pylist()):
            own = found[i].values.to_numpy()
            if at == now:
                sums += own
                continue
            if now >= 0:
                yield cuts(now, sums)
            now, sums = at, own.copy()
    if now >= 0:
        yield cuts(now, sums)


CHOSEN = ("gain", "cut", "left_w", "left_s", "w", "s")


def grow_forest(rows: DataFrame, width: int, trees: int, depth: int, bins: int = 32, seed: int = 42) -> list[list[dict]]:
    """The nodes of regression trees for ``score`` by ``values``, ``width`` numbers a row, at most ``bins`` (up to 256) bins each.

    Each tree is grown on a bootstrap of all rows and tries all features at every node.  Nodes are as
    :func:`labelweave.learning.importance.leaf_boxes` takes them.
    """
    edges = feature_edges(rows, width, bins)
    sizes = [len(e) + 1 for e in edges]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = binned(matrix_of(batch.column("values")), edges).astype(np.uint8) if batch.num_rows else np.empty((0, width), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cells], pa.binary()), batch.column("score")], names=["cell", "score"])

    cells = rows.select("values", "score").mapInArrow(cut_up, "cell binary, score double").groupBy("cell", "score").agg(F.count("*").alias("n"))
    ready = stage(cells.sortWithinPartitions("cell", "score"), "trial_cells")
    mean = ready.agg(F.sum(F.col("score") * F.col("n")) / F.sum("n")).first()[0]
    keyed = ready.select("cell", "score", "n", F.xxhash64("cell", "score").alias("row"))
    # node i has the children 2 i + 1 and 2 i + 2; one place more than nodes, for rows of ended branches
    places = 2 ** (depth + 1)
    feature, cut = np.full((trees, places), -1, np.int16), np.zeros((trees, places), np.uint8)
    w, s = np.zeros((trees, places)), np.zeros((trees, places))
    for level in range(depth):
        sums = keyed.mapInArrow(lambda b, f=feature.copy(), c=cut.copy(), n=level: _sums(b, f, c, n, sizes, seed, mean), "at int, sums array<double>")
        dealt = sums.repartition("at").sortWithinPartitions("at")
        best = dealt.mapInArrow(lambda b, n=level: _chosen(b, n), "at int, " + ", ".join(f"{c} array<double>" for c in CHOSEN)).toArrow()
        first, count = (1 << level) - 1, 1 << level
        found = {c: matrix_of(best.column(c).combine_chunks())[np.argsort(best.column("at").to_numpy())].reshape(trees, width, count) for c in CHOSEN}
        if not level:
            w[:, 0], s[:, 0] = found["w"][:, 0, 0], found["s"][:, 0, 0]
        # equal gains go to the first feature
        gain = found["gain"]
        chosen = (gain >= gain.max(1, keepdims=True) * (1 - 10.0**-PLACES)).argmax(1)
        for t, node in np.argwhere(gain.max(1) > 0):
            f, at = chosen[t, node], first + node
            feature[t, at], cut[t, at] = f, int(found["cut"][t, f, node])
            for to, place, left in ((w, "w", "left_w"), (s, "s", "left_s")):
                to[t, 2 * at + 1] = found[left][t, f, node]
                to[t, 2 * at + 2] = found[place][t, f, node] - found[left][t, f, node]
        if not (gain > 0).any():
            break
    return [[_node(i, feature[t], cut[t], w[t], s[t], edges, mean) for i in range(places - 1) if not i or w[t, i] > 0] for t in range(trees)]


def _node(i: int, feature: np.ndarray, cut: np.ndarray, w: np.ndarray, s: np.ndarray, edges: list[np.ndarray], mean: float) -> dict:
    f = int(feature[i])
    threshold = float(edges[f][cut[i]]) if f >= 0 else None
    return {"id": i, "feature": f, "threshold": threshold, "left": 2 * i + 1 if f >= 0 else -1, "right": 2 * i + 2 if f >= 0 else -1, "value": mean + (s[i] / w[i] if w[i] else 0.0)}
