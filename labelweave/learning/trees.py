"""Decision trees, forests and second-order boosting, grown for many jobs at once.

A *job* is one fit: a specification on one *set* of rows (a fold, a balanced copy).  All jobs of a sweep are grown together.  Features are cut at
quantiles of the set's training rows.

* Large sets grow level by level: one pass over the rows sums statistics per (job, tree, node, feature, bin) inside each task, Spark adds them
  up, and the best split of every open node of every job is chosen from the sums.  The number of passes follows the depth (and the rounds of
  boosting), not the number of jobs.  Nodes small enough for a task (as below) wait until the others are split; then one pass sends their rows, as
  bins, to a task per node, which grows the rest below it.
* A set of at most ``jobs.LOCAL_CELLS`` feature values is small enough that a task can hold all of it: there each of its jobs is grown in
  one task, with the same splits, and all jobs side by side.

Random choices are hashes of (seed, tree, row or node), so both ways draw alike and a retried task repeats its draws.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.runtime import stage

#: Most bins of a feature, and statistics that a task holds in a pass.
MOST_BINS, HELD = 65_535, 1 << 22
#: Feature values that a pass looks at together.
PASS_CELLS = 1 << 21
#: Rounds of boosting after which the rows are written anew with the margins reached, so that a pass applies no more trees than these.
KEPT_ROUNDS = 8
#: Cells that a step over some features touches together when boosting grows in memory, so that its arrays stay near the processor.
STEP_CELLS = 1 << 16
#: Cells of a step when a classification tree grows in memory, and sums (per feature, node and bin) up to which those of a level are kept for the next one.
COUNT_CELLS, KEPT_SUMS = 1 << 18, 1 << 22
#: Places to which gains are compared; equal ones go to the smallest feature, then the smallest bin.
PLACES = 9


@dataclass(frozen=True)
class TreeSpec:
    """What a job grows: ``kind`` is tree, forest or boost."""

    kind: str
    n_classes: int = 2
    n_trees: int = 1
    depth: int = 30
    min_split: int = 2
    min_leaf: int = 1
    min_hessian: float = 0.0
    criterion: str = "gini"
    subset: str = "None"  # features tried per node
    column_share: float = 1.0  # features tried per tree
    bootstrap: bool = False
    random_split: bool = False
    balanced: bool = False
    positive_weight: float = 1.0
    bins: int = 255
    rate: float = 0.1
    l2: float = 0.0
    l1: float = 0.0
    gamma: float = 0.0
    row_share: float = 1.0
    temperature: float = 0.0  # of the weights of a Bayesian bootstrap
    noise: float = 0.0  # random strength of the split scores
    seed: int = 42

    @property
    def outputs(self) -> int:
        """Trees of a round."""
        return self.n_classes if self.kind == "boost" and self.n_classes > 2 else 1

    @property
    def channels(self) -> int:
        """Statistics per bin: a weight per class, or gradient and Hessian; and the number of rows."""
        return (2 if self.kind == "boost" else self.n_classes) + 1


# ---------------------------------------------------------------- hashes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(*parts) -> np.ndarray:
    """Numbers in (0, 1) by integers; arrays are broadcast."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for part in parts:
            out = _mix((out ^ np.asarray(part).astype(np.int64).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    return ((out >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def row_weights(spec: TreeSpec, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often, or with what weight, a tree sees each row."""
    u = draws(spec.seed, 1, tree, rows) if spec.bootstrap or spec.row_share < 1 or spec.temperature else None
    if spec.bootstrap:
        # a Poisson bootstrap: counts by inversion
        steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
        return np.searchsorted(steps, u).astype(float)
    if spec.row_share < 1:
        return (u < spec.row_share).astype(float)
    if spec.temperature:
        return (-np.log(u)) ** spec.temperature
    return np.ones(len(rows))


def tree_features(spec: TreeSpec, tree: int, width: int) -> np.ndarray:
    """The features that a tree may use, ascending."""
    if spec.column_share >= 1:
        return np.arange(width)
    ranked = np.argsort(draws(spec.seed, 2, tree, np.arange(width)), kind="stable")
    return np.sort(ranked[: max(1, round(spec.column_share * width))])


def node_features(spec: TreeSpec, tree: int, nodes: np.ndarray, features: np.ndarray) -> np.ndarray | None:
    """Mask ``(features, nodes)`` of the features that each node tries; None for all."""
    k = len(features)
    most = {"sqrt": int(math.sqrt(k)), "log2": int(math.log2(k))}.get(spec.subset, k)
    if max(1, most) >= k:
        return None
    u = draws(spec.seed, 3, tree, nodes[:, None], features[None, :])
    tried = u <= np.partition(u, max(1, most) - 1, axis=1)[:, [max(1, most) - 1]]
    if (tried.sum(1) != max(1, most)).any():  # equal draws
        tried = np.argsort(np.argsort(u, axis=1, kind="stable"), axis=1, kind="stable") < max(1, most)
    return tried.T


# ---------------------------------------------------------------- splits


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _step_score(spec: TreeSpec, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h + spec.l2
    return 0.5 * (_soft(g, spec.l1) if spec.l1 else g) ** 2 / np.where(h > 0, h, np.inf)


def _score(spec: TreeSpec, s: np.ndarray) -> np.ndarray:
    """What splitting tries to raise: the negative impurity times the weight, or the loss that a leaf takes away."""
    if spec.kind == "boost":
        return _step_score(spec, s[..., 0], s[..., 1])
    w = s[..., :-1]
    total = w.sum(-1)
    if spec.criterion == "gini":
        return (w**2).sum(-1) / np.where(total > 0, total, np.inf)
    return np.where(w > 0, w * np.log(np.where(w > 0, w, 1.0)), 0.0).sum(-1) - np.where(total > 0, total * np.log(np.where(total > 0, total, 1.0)), 0.0)


def gains(spec: TreeSpec, left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Gain of splitting ``total`` into ``left`` and the rest, in comparable places; -inf where the split is not allowed."""
    right = total - left
    gain = _score(spec, left) + _score(spec, right) - _score(spec, total) - spec.gamma
    allowed = (left[..., -1] >= spec.min_leaf) & (right[..., -1] >= spec.min_leaf)
    if spec.kind == "boost":
        least = max(spec.min_hessian, 1e-12)
        allowed &= (left[..., 1] >= least) & (right[..., 1] >= least)
        unit = total[..., 1] + np.abs(total[..., 0])
    else:
        unit = total[..., :-1].sum(-1)
    relative = np.round(gain / np.where(unit > 0, unit, 1.0), PLACES)
    return np.where(allowed & (relative > 0), relative, -np.inf)


def noisy(spec: TreeSpec, tree: int, nodes: np.ndarray, features: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Scores by which a node's features (axis 0) are compared: gains with noise of the spread of the node's gains."""
    if not spec.noise:
        return gain
    finite = np.isfinite(gain)
    known = np.where(finite, gain, 0.0)
    spread = np.sqrt((known**2).sum(0) / np.maximum(finite.sum(0), 1))
    u, v = (draws(spec.seed, k, tree, nodes[None, :], features[:, None]) for k in (4, 5))
    return np.where(finite, gain + spec.noise * spread * 0.1 * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v), -np.inf)


def leaf_values(spec: TreeSpec, s: np.ndarray) -> np.ndarray:
    """What leaves say: class shares, or the shrunken Newton step."""
    if spec.kind == "boost":
        h = s[..., 1:2] + spec.l2
        return -spec.rate * _soft(s[..., :1], spec.l1) / np.where(h > 0, h, np.inf)
    total = s[..., :-1].sum(-1, keepdims=True)
    return np.where(total > 0, s[..., :-1] / np.where(total > 0, total, 1.0), 1.0 / spec.n_classes)


class Tree:
    """A growing tree; nodes in the order of their creation, ``number`` is their place in the full binary tree."""

    def __init__(self, spec: TreeSpec, total: np.ndarray, number: int = 1, level: int = 0):
        self.spec = spec
        self.feature, self.bin = np.full(1, -1, np.int32), np.zeros(1, np.int64)
        self.left = np.zeros(1, np.int32)
        self.number, self.level = np.full(1, number, np.int64), np.full(1, level, np.int16)
        self.stats = total[None, :].astype(float)
        self.open = self._may_split(np.zeros(1, np.int32))
        self.waiting = np.empty(0, np.int32)

    def _may_split(self, nodes: np.ndarray) -> np.ndarray:
        s = self.stats[nodes]
        fit = (self.level[nodes] < self.spec.depth) & (s[:, -1] >= max(2, self.spec.min_split, 2 * self.spec.min_leaf))
        if self.spec.kind != "boost":
            fit &= (s[:, :-1] > 0).sum(1) > 1
        return nodes[fit]

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> None:
        """Split ``nodes``; all other open nodes become leaves."""
        n, k = len(self.feature), len(nodes)
        self.feature[nodes], self.bin[nodes], self.left[nodes] = feature, cut, n + 2 * np.arange(k)
        children = np.stack([left, self.stats[nodes] - left], 1).reshape(2 * k, self.stats.shape[1])
        self.feature = np.append(self.feature, np.full(2 * k, -1, np.int32))
        self.bin, self.left = np.append(self.bin, np.zeros(2 * k, np.int64)), np.append(self.left, np.zeros(2 * k, np.int32))
        self.number = np.append(self.number, (2 * self.number[nodes][:, None] + np.arange(2)).ravel())
        self.level = np.append(self.level, np.repeat(self.level[nodes] + 1, 2).astype(np.int16))
        self.stats = np.vstack([self.stats, children])
        self.open = self._may_split(np.arange(n, n + 2 * k, dtype=np.int32))

    def put_off(self, most_rows: float) -> None:
        """Open nodes of at most so many rows wait for being finished in a task."""
        small = self.stats[self.open, -1] <= most_rows
        self.waiting, self.open = np.append(self.waiting, self.open[small]), self.open[~small]

    def graft(self, node: int, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, stats: np.ndarray) -> None:
        """Put a subtree, whose first node is its root, in the place of ``node``."""
        n = len(self.feature)
        left = np.where(feature >= 0, left + n - 1, 0).astype(np.int32)
        self.feature[node], self.bin[node], self.left[node] = feature[0], cut[0], left[0]
        self.feature, self.bin, self.left = np.append(self.feature, feature[1:]), np.append(self.bin, cut[1:]), np.append(self.left, left[1:])
        self.stats = np.vstack([self.stats, stats[1:]])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The node at which each binned row ends."""
        return route(self.feature, self.bin, self.left, x)

    def values(self) -> np.ndarray:
        return leaf_values(self.spec, self.stats)


def route(feature: np.ndarray, limit: np.ndarray, left: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int32)
    rows = np.arange(len(x)) if feature[0] >= 0 else np.empty(0, int)
    while len(rows):
        here = at[rows]
        f = feature[here]
        at[rows] = left[here] + (x[rows, f] > limit[here])
        rows = rows[feature[at[rows]] >= 0]
    return at


def _sums_of(own: np.ndarray, slot: np.ndarray, held: list[np.ndarray | None], k: int, bins: int) -> np.ndarray:
    """Sums ``(channel, feature, node, bin)`` of the rows by their node's ``slot``; a channel without values counts rows."""
    n = len(slot)
    out = np.empty((3, len(own), k, bins))
    step = min(len(own), max(1, STEP_CELLS // max(1, n)))
    tiled = [None if v is None else np.tile(v, step) for v in held]
    base, size = slot.astype(np.int64) * bins, k * bins
    for a in range(0, len(own), step):
        w = min(step, len(own) - a)
        at = (own[a : a + w] + base + (np.arange(w) * size)[:, None]).ravel()
        for c, t in enumerate(tiled):
            out[c, a : a + w] = np.bincount(at, None if t is None else t[: len(at)], w * size).reshape(w, k, bins)
    return out


def _best_by_sums(spec: TreeSpec, sums: np.ndarray, total: np.ndarray, gain: np.ndarray) -> None:
    """Fill in the gains of all cuts by sums ``(channel, feature, node, bin)``."""
    all_g, all_h, all_n = (total[:, c][:, None] for c in range(3))
    whole, least = _score(spec, total)[:, None], max(spec.min_hessian, 1e-12)
    step = max(1, STEP_CELLS // max(1, sums[0, 0].size))
    for a in range(0, sums.shape[1], step):
        n = sums[2, a : a + step]
        left_g, left_h = (sums[c, a : a + step].cumsum(2) for c in range(2))
        right_h = all_h - left_h
        part = _step_score(spec, left_g, left_h) + _step_score(spec, all_g - left_g, right_h) - whole - spec.gamma
        left_n = n.cumsum(2)
        # a cut is behind a bin that has rows
        part[(n == 0) | (left_n < spec.min_leaf) | (all_n - left_n < max(1, spec.min_leaf)) | (left_h < least) | (right_h < least)] = -np.inf
        gain[a : a + step] = part


def _grow_by_sums(spec: TreeSpec, number: int, tree: Tree, features: np.ndarray, columns: np.ndarray, stats: np.ndarray, place: np.ndarray, closed: int) -> None:
    """Grow a boosting tree level by level from sums per (feature, node, bin), as long as these are not many more than the rows' cells.

    Of two sibling nodes the smaller is summed; the other has the rest of their parent's sums.  ``columns`` are the bins by feature; ``place`` has the open
    node of every row, or ``closed``, and is kept up to date.
    """
    live = np.flatnonzero(place != closed)
    own = columns if len(live) == columns.shape[1] else columns[:, live]
    bins = int(own.max()) + 1
    slot = place[live].astype(np.int64)
    held = [np.ascontiguousarray(stats[live, c]) for c in range(3)]
    plain = bool((held[2] == 1).all())
    before = parent = None
    while 0 < len(tree.open) and len(tree.open) * bins <= 4 * len(live):
        nodes, k = tree.open, len(tree.open)
        on = slot < k
        if on.sum() < 0.75 * len(live):
            live, own, slot = live[on], np.ascontiguousarray(own[:, on]), slot[on]
            held = [v[on] for v in held]
        total = tree.stats[nodes]
        # nodes summed from their rows; the others by their sibling
        direct, sibling = np.ones(k, bool), np.full(k, -1)
        if before is not None:
            pair = np.flatnonzero(parent[1:] == parent[:-1])
            other = np.where(total[pair, 2] > total[pair + 1, 2], pair, pair + 1)
            direct[other], sibling[other] = False, 2 * pair + 1 - other
        summed = np.cumsum(direct) - 1
        use = np.flatnonzero(np.append(direct, False)[slot])
        cells = own if len(use) == len(live) else own.take(use, 1)
        counts = None if plain else held[2][use]
        found = _sums_of(cells, summed[slot[use]], [held[0][use], held[1][use], counts], int(direct.sum()), bins)
        if direct.all():
            sums = found
        else:
            sums = np.empty((3, len(own), k, bins))
            sums[:, :, direct] = found
            rest = np.flatnonzero(~direct)
            sums[:, :, rest] = before[:, :, parent[rest]] - found[:, :, summed[sibling[rest]]]
        gain = np.empty(sums.shape[1:])
        _best_by_sums(spec, sums, total, gain)
        # rounding keeps the order, so that the largest gain alone is rounded
        unit = total[:, 1] + np.abs(total[:, 0])
        unit = np.where(unit > 0, unit, 1.0)
        best = np.round(gain.max(2) / unit, PLACES)
        tried = node_features(spec, number, tree.number[nodes], features)
        best[~(best > 0) | (False if tried is None else ~tried)] = -np.inf
        score = noisy(spec, number, tree.number[nodes], features, best)
        f, at = score.argmax(0), np.arange(k)
        good = np.isfinite(score[f, at])
        # the first cut with the best gain
        cut = (np.round(gain[f, at] / unit[:, None], PLACES) == best[f, at][:, None]).argmax(1)
        on = np.append(good, False)[slot]
        f_of, cut_of = np.append(f, 0)[slot], np.append(cut, 0)[slot]
        below = own[f_of, np.arange(len(live))] <= cut_of
        left = np.stack([np.bincount(slot, v * below, k + 1)[:k] for v in held], 1)
        first = len(tree.feature)
        tree.split(nodes[good], features[f[good]], cut[good], left[good])
        ends = np.full(len(tree.feature) + 1, len(tree.open), np.int64)
        ends[tree.open] = np.arange(len(tree.open))
        child = tree.left[np.append(nodes, 0)[slot]] + ~below
        slot = np.where(on, ends[np.where(on, child, -1)], len(tree.open))
        kept = sums[0].size <= KEPT_SUMS
        before, parent = (sums, np.flatnonzero(good)[(tree.open - first) // 2]) if kept else (None, None)
    place[:] = closed
    on = slot < len(tree.open)
    place[live[on]] = slot[on]


def _classes_of(spec: TreeSpec, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The label and whole-numbered weight of each row, and the factor of each class, by the statistics of a classification tree; None where they are not such."""
    weight, label = stats[:, -1], stats[:, :-1].argmax(1)
    most = weight.max(initial=0)
    if spec.kind == "boost" or spec.random_split or spec.noise or most >= 1 << 16 or (weight != np.floor(weight)).any():
        return None
    own = stats[np.arange(len(stats)), label]
    factor = np.ones(spec.n_classes)
    for c in range(spec.n_classes):
        at = np.flatnonzero((label == c) & (weight > 0))[:1]
        factor[c] = own[at[0]] / weight[at[0]] if len(at) else 1.0
    if (factor <= 0).any() or not np.allclose(own, factor[label] * weight, rtol=1e-12, atol=0):
        return None
    return label, weight.astype(np.int64), factor


def _impurity(spec: TreeSpec, w: list[np.ndarray]) -> np.ndarray:
    """As :func:`_score` of a classification tree, by an array for each class."""
    total = sum(w)
    if spec.criterion == "gini":
        return sum(v * v for v in w) / np.where(total > 0, total, np.inf)
    log = lambda v: v * np.log(np.where(v > 0, v, 1.0))
    return sum(log(v) for v in w) - log(total)


def _cuts_by_counts(spec: TreeSpec, cells: np.ndarray, slot: np.ndarray, k: int, label: np.ndarray, weight: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of every (node, column) in order, and its bins behind which a best cut may be, the last one included: the number of the pair, the bin, and the weight of each class up to it.

    Between bins that only have rows of one and the same class the gain has no maximum, unless the least size of a leaf ends there.
    """
    n, s = cells.shape
    classes = spec.n_classes
    if 4 * k * bins * classes <= n:
        pair = slot[:, None] * s + np.arange(s)
        key = ((pair * bins + cells) * classes + label[:, None]).ravel()
        counts = np.bincount(key, None if (weight == 1).all() else np.repeat(weight, s), k * s * bins * classes).reshape(k * s * bins, classes)
        parts = [np.ascontiguousarray(counts[:, c], float) for c in range(classes)]
        filled = np.flatnonzero(sum(parts) > 0)
        group, cut = np.divmod(filled, bins)
        return group, cut, [p.reshape(k * s, bins).cumsum(1).ravel()[filled] for p in parts]
    # sorted by pair, bin and class, with the weight in the last bits
    bit = lambda most: max(1, int(most).bit_length())
    low, mid, high, column = bit(weight.max()), bit(classes - 1), bit(bins - 1), bit(s - 1)
    kind = np.int32 if bit(k - 1) + column + high + mid + low < 32 else np.int64
    key = cells.astype(kind)
    key <<= kind(mid + low)
    key += ((slot.astype(kind) << kind(column + high + mid + low)) + ((label << low) | weight).astype(kind))[:, None]
    key += np.arange(s, dtype=kind) << kind(high + mid + low)
    key = key.ravel()
    key.sort()
    place = key >> kind(mid + low)
    last = np.append(np.flatnonzero(place[1:] != place[:-1]), len(place) - 1)
    of_class = (key >> kind(low)) & kind((1 << mid) - 1)
    place = place[last]
    group = place >> kind(high)
    new = group[1:] != group[:-1]
    ends = np.append(np.flatnonzero(new), len(group) - 1)
    size = np.diff(ends, prepend=-1)
    top, bottom = of_class[last], of_class[np.append(0, last[:-1] + 1)]
    w = None if (weight == 1).all() else key & kind((1 << low) - 1)
    total = (last + 1 if w is None else w.cumsum()[last]).astype(float)
    keep = np.append((bottom[:-1] != top[:-1]) | (top[:-1] != bottom[1:]) | (bottom[1:] != top[1:]), True)
    keep[ends] = True
    if spec.min_leaf > 1:
        before = np.repeat(np.append(0.0, total[ends[:-1]]), size)
        allowed = (total - before >= spec.min_leaf) & (np.repeat(total[ends], size) - total >= spec.min_leaf)
        keep |= allowed & ~(np.append(False, allowed[:-1]) & np.append(allowed[1:], False))
    kept = np.flatnonzero(keep)
    size = np.diff(np.searchsorted(kept, ends), prepend=-1)

    def up_to(run: np.ndarray) -> np.ndarray:
        return run[kept] - np.repeat(np.append(0.0, run[ends[:-1]]), size)

    left = [up_to(total)]
    for c in range(1, classes):
        own = of_class if classes == 2 else of_class == c
        left.append(up_to((own if w is None else own * w).cumsum()[last].astype(float)))
    left[0] -= sum(left[1:])
    return np.repeat(np.arange(k * s), size), place[kept] & kind((1 << high) - 1), left


def _grow_by_counts(spec: TreeSpec, number: int, tree: Tree, features: np.ndarray, x: np.ndarray, label: np.ndarray, weight: np.ndarray, factor: np.ndarray) -> None:
    """Grow a classification tree level by level from the weights of the classes per (node, tried feature, bin); ``x`` are the bins by row."""
    rows = np.flatnonzero(weight > 0)
    slot = np.zeros(len(rows), np.int64)
    bins, flat = int(x.max(initial=0)) + 1, x.ravel()
    while len(tree.open):
        nodes, k = tree.open, len(tree.open)
        tried = node_features(spec, number, tree.number[nodes], features)
        s = len(features) if tried is None else int(tried[:, 0].sum())
        of_node = None if tried is None else features[np.nonzero(tried.T)[1].reshape(k, s)]
        starts = np.searchsorted(slot, np.arange(k + 1))
        total = tree.stats[nodes, :-1]
        unit = total.sum(1)
        whole = _impurity(spec, list(total.T))
        count = np.rint(total / factor)
        best, best_f, best_cut, best_left = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, spec.n_classes))
        a = 0
        while a < k:
            # some nodes, or some columns of a large one
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + COUNT_CELLS // s, "right")) - 1)
            here, own = rows[starts[a] : starts[b]], slot[starts[a] : starts[b]] - a
            step = s if b > a + 1 else max(1, COUNT_CELLS // max(1, len(here)))
            for j in range(0, s, step):
                columns = features[j : j + step] if of_node is None else of_node[a:b, j : j + step]
                if of_node is None:
                    cells = x[here] if len(columns) == x.shape[1] else flat.take((here * x.shape[1])[:, None] + columns)
                else:
                    cells = flat.take((here * x.shape[1])[:, None] + columns[own])
                w = cells.shape[1]
                group, cut, left = _cuts_by_counts(spec, cells, own, b - a, label[here], weight[here], bins)
                ends = np.flatnonzero(np.append(group[1:] != group[:-1], True))
                begins = np.append(0, ends[:-1] + 1)
                of_group, size = np.repeat(np.arange(a, b), w), ends - begins + 1
                rest = [np.repeat(count[of_group, c], size) - v for c, v in enumerate(left)]
                score = _impurity(spec, [v if y == 1 else v * y for v, y in zip(left, factor)]) + _impurity(spec, [v if y == 1 else v * y for v, y in zip(rest, factor)])
                score[ends] = -np.inf
                if spec.min_leaf > 1:
                    score[(sum(left) < spec.min_leaf) | (sum(rest) < spec.min_leaf)] = -np.inf
                # rounding keeps the order, so that few gains are rounded
                most = np.maximum.reduceat(score, begins)
                likely = np.flatnonzero(score >= np.repeat(most - 2 * 10.0**-PLACES * unit[of_group], size))
                relative = lambda score, of: np.round((score - whole[of] - spec.gamma) / unit[of], PLACES)
                most = relative(most, of_group)
                likely = likely[relative(score[likely], of_group[group[likely]]) == most[group[likely]]]
                # the first cut with the best gain
                first = np.zeros(len(most), np.int64)
                first[group[likely][::-1]] = likely[::-1]
                most = most.reshape(b - a, w)
                f, node = most.argmax(1), np.arange(b - a)
                better = (most[node, f] > 0) & (most[node, f] > best[a:b])
                won, f, node = first.reshape(b - a, w)[node, f][better], f[better], node[better]
                best[a + node], best_cut[a + node] = most[node, f], cut[won]
                best_f[a + node] = columns[f] if of_node is None else columns[node, f]
                best_left[a + node] = np.stack([v[won] for v in left], 1)
            a = b
        good = best > 0
        tree.split(nodes[good], best_f[good], best_cut[good], np.hstack([best_left * factor, best_left.sum(1, keepdims=True)])[good])
        ends = np.full(len(tree.feature), -1, np.int64)
        ends[tree.open] = np.arange(len(tree.open))
        rows, slot = rows[good[slot]], slot[good[slot]]
        child = tree.left[nodes[slot]] + (flat.take(rows * x.shape[1] + best_f[slot]) > best_cut[slot])
        slot = ends[child]
        rows, slot = rows[slot >= 0], slot[slot >= 0]
        order = np.argsort(slot.astype(np.uint16) if len(tree.open) < 1 << 16 else slot, kind="stable")
        rows, slot = rows[order], slot[order]


def by_bin(columns: np.ndarray) -> np.ndarray:
    """The rows in the order of their bins, for each feature."""
    return np.argsort(columns, axis=1, kind="stable").astype(np.int32)


def grow_here(
    spec: TreeSpec, number: int, x: np.ndarray, stats: np.ndarray, root: int = 1, level: int = 0, columns: np.ndarray | None = None, order: np.ndarray | None = None
) -> Tree:
    """Grow a tree, or from another ``root`` a subtree, on rows held in memory; rows that count nothing are left out.

    ``columns`` is ``x`` by feature and ``order`` the rows by bin for each feature, where they are at hand.
    """
    use = stats[:, -1] > 0
    features = tree_features(spec, number, x.shape[1])
    tree = Tree(spec, stats[use].sum(0), root, level)
    if not len(tree.open):
        return tree
    classes = _classes_of(spec, stats)
    if classes:
        _grow_by_counts(spec, number, tree, features, x, *classes)
        return tree
    columns = np.ascontiguousarray(x[:, features].T) if columns is None else columns if len(features) == x.shape[1] else columns[features]
    kind = np.uint16 if len(x) < 65_535 else np.uint32
    closed = np.iinfo(kind).max
    place = np.where(use, 0, closed).astype(kind)
    if spec.kind == "boost" and not spec.random_split:
        _grow_by_sums(spec, number, tree, features, columns, stats, place, closed)
        if not len(tree.open):
            return tree
    order = by_bin(columns) if order is None else order[features]
    order = order[(place != closed)[order]].reshape(len(features), -1)
    if len(tree.open) > 1:
        order = np.take_along_axis(order, np.argsort(place[order], axis=1, kind="stable"), 1)
    while len(tree.open):
        nodes = tree.open
        node = place[order[0]]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        # rows by (node, bin): running sums inside a node are the left sides of its cuts
        sums = stats[order].cumsum(1)
        before = np.zeros((len(features), len(starts), sums.shape[2]))
        before[:, 1:] = sums[:, starts[1:] - 1]
        size = np.diff(np.append(starts, order.shape[1]))
        total = tree.stats[nodes]
        bins = np.take_along_axis(columns, order, 1)
        # a cut is between two bins of one node, at a feature that the node tries
        cut = np.zeros(bins.shape, bool)
        cut[:, :-1] = (bins[:, 1:] != bins[:, :-1]) & (node[1:] == node[:-1])
        if spec.random_split:
            low, high = bins[:, starts], bins[:, starts + size - 1]
            u = draws(spec.seed, 6, number, tree.number[nodes][None, :], features[:, None])
            limit = np.repeat(low + np.floor(u * (high - low)).astype(bins.dtype), size, axis=1)
            cut[:, :-1] &= (bins[:, :-1] <= limit[:, :-1]) & (bins[:, 1:] > limit[:, :-1])
        tried = node_features(spec, number, tree.number[nodes], features)
        if tried is not None:
            cut &= np.repeat(tried, size, axis=1)
        at_f, at_row = np.nonzero(cut)
        of_node = np.repeat(np.arange(len(starts)), size)[at_row]
        left = sums[at_f, at_row] - before[at_f, of_node]
        gain = np.full(bins.shape, -np.inf)
        gain[at_f, at_row] = gains(spec, left, total[of_node])
        best = np.maximum.reduceat(gain, starts, axis=1)
        score = noisy(spec, number, tree.number[nodes], features, best)
        f = score.argmax(0)
        k = np.arange(len(nodes))
        good = np.isfinite(score[f, k])
        # the first cut with the best gain
        hit = gain[f.repeat(size), np.arange(order.shape[1])] == np.repeat(best[f, k], size)
        at = np.minimum.reduceat(np.where(hit, np.arange(order.shape[1]), order.shape[1]), starts)
        f, at, chosen = f[good], at[good], nodes[good]
        cut_left, cut_bin = sums[f, at] - before[f, np.flatnonzero(good)], bins[f, at]
        tree.split(chosen, features[f], cut_bin, cut_left)
        # rows go on with their child if it is open
        ends = np.full(len(tree.feature), closed, kind)
        ends[tree.open] = np.arange(len(tree.open))
        rows = order[0]
        parent = nodes[node]
        went = tree.feature[parent] >= 0
        child = tree.left[parent] + (x[rows, np.maximum(tree.feature[parent], 0)] > tree.bin[parent])
        place[rows] = np.where(went, ends[np.where(went, child, 0)], closed)
        moved = place[order]
        sort = np.argsort(moved, axis=1, kind="stable")[:, : int((moved[0] < closed).sum())]
        order = np.take_along_axis(order, sort, 1)
    return tree


# ---------------------------------------------------------------- models


@dataclass
class TreeModel:
    """A fitted job: per tree its features, thresholds, left children and values; and the start of boosting."""

    spec: TreeSpec
    start: np.ndarray
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def proba(self, x: np.ndarray) -> np.ndarray:
        spec = self.spec
        if spec.kind != "boost":
            parts = [value[route(f, t, left, x)] for f, t, left, value in self.trees]
            return sum(parts) / len(parts)
        margin = np.repeat(self.start[None, :], len(x), axis=0)
        for i, (f, t, left, value) in enumerate(self.trees):
            margin[:, i % spec.outputs] += value[route(f, t, left, x), 0]
        return link(margin)


def link(margin: np.ndarray) -> np.ndarray:
    """Class probabilities: logistic of one margin, softmax of several."""
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return np.hstack([1 - p, p])
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def class_factors(spec: TreeSpec, counts: np.ndarray) -> np.ndarray:
    """The weight of each class."""
    out = np.ones(spec.n_classes)
    if spec.balanced:
        present = counts > 0
        out[present] = counts.sum() / (present.sum() * counts[present])
    elif spec.positive_weight != 1 and spec.n_classes == 2:
        out[1] = spec.positive_weight
    return out


def start_of(spec: TreeSpec, weights: np.ndarray) -> np.ndarray:
    """The margins that boosting starts from: the log odds, or the logs of the class shares."""
    share = np.maximum(weights / weights.sum(), 1e-9) if weights.sum() > 0 else np.full(spec.n_classes, 1 / spec.n_classes)
    return np.array([math.log(share[1] / share[0])]) if spec.outputs == 1 else np.log(share)


def gradients(spec: TreeSpec, margin: np.ndarray, label: np.ndarray, output: int) -> np.ndarray:
    """First and second derivatives of the logistic or softmax loss of one output."""
    p = link(margin)[:, output if spec.outputs > 1 else 1]
    return np.stack([p - (label == (output if spec.outputs > 1 else 1)), np.maximum(p * (1 - p), 1e-16)], 1)


def statistics(spec: TreeSpec, label: np.ndarray, weight: np.ndarray, factor: np.ndarray, margin: np.ndarray | None, output: int) -> np.ndarray:
    """The channels of each row of a tree."""
    if spec.kind == "boost":
        out = gradients(spec, margin, label, output) * (weight * factor[label])[:, None]
    else:
        out = np.zeros((len(label), spec.n_classes))
        out[np.arange(len(label)), label] = weight * factor[label]
    # a bootstrap counts a row as often as it is drawn, other weights count it once
    return np.hstack([out, (weight if spec.bootstrap else weight > 0)[:, None]])


def job_edges(edges: list[np.ndarray], bins: int) -> list[np.ndarray]:
    """Of the edges of each feature as many as leave at most ``bins`` bins."""
    return [e if len(e) < bins else e[np.arange(1, bins) * len(e) // bins] for e in edges]


def binned(x: np.ndarray, edges: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    """The bin of each value: the number of edges below it."""
    out = np.empty(x.shape, kind)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, x[:, f], "left")
    return out


def coarser(cells: np.ndarray, edges: list[np.ndarray], bins: int) -> np.ndarray:
    """The bins by :func:`job_edges` of values whose bins by all edges are known."""
    if all(len(e) < bins for e in edges):
        return cells
    out = np.empty_like(cells)
    for f, e in enumerate(edges):
        kept = np.arange(len(e)) if len(e) < bins else np.arange(1, bins) * len(e) // bins
        out[:, f] = np.searchsorted(kept, np.arange(len(e) + 1), "left").astype(cells.dtype)[cells[:, f]]
    return out


def effort(spec: TreeSpec, width: int) -> float:
    """About how long a job takes for each row of its set, against others."""
    if spec.kind == "boost":
        return spec.n_trees * spec.outputs * min(spec.depth, 10) * width * 0.035
    tried = {"sqrt": math.sqrt(width), "log2": math.log2(max(2, width))}.get(spec.subset, width)
    return spec.n_trees * min(spec.depth, 25) * (tried + 2) * 0.2


def thresholds(edges: list[np.ndarray], feature: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The values at which splits cut."""
    return np.array([edges[f][b] if f >= 0 else 0.0 for f, b in zip(feature, bins)])


def fit_here(spec: TreeSpec, x: np.ndarray, label: np.ndarray, rows: np.ndarray, edges: list[np.ndarray]) -> TreeModel:
    """Fit a job on training rows held in memory; ``rows`` are the hashes of their keys."""
    edges = job_edges(edges, spec.bins)
    model = fit_bins(spec, binned(x, edges), label, rows)
    return TreeModel(spec, model.start, [(f, thresholds(edges, f, cut), left, values) for f, cut, left, values in model.trees])


def fit_bins(spec: TreeSpec, cells: np.ndarray, label: np.ndarray, rows: np.ndarray) -> TreeModel:
    """As :func:`fit_here` by the rows' bins; the model's thresholds are bins as well."""
    boost = spec.kind == "boost"
    columns = np.ascontiguousarray(cells.T) if boost or spec.random_split else None
    counts = np.bincount(label, minlength=spec.n_classes).astype(float)
    factor = class_factors(spec, counts)
    start = start_of(spec, counts * factor) if boost else np.zeros(1)
    margin = np.repeat(start[None, :], len(cells), axis=0) if boost else None
    # small sets go by sorted rows early
    order = by_bin(columns) if columns is not None and (spec.random_split or 4 * len(cells) < (1 << min(spec.depth, 20)) * (int(cells.max(initial=0)) + 1)) else None
    trees = []
    for i in range(spec.n_trees):
        weight = row_weights(spec, i, rows)
        before = margin.copy() if spec.outputs > 1 else margin
        for k in range(spec.outputs):
            number = i * spec.outputs + k
            tree = grow_here(spec, number, cells, statistics(spec, label, weight, factor, before, k), columns=columns, order=order)
            values = tree.values()
            if boost:
                margin[:, k] += values[tree.leaves_of(cells), 0]
            trees.append((tree.feature, tree.bin, tree.left, values))
    return TreeModel(spec, start, trees)


# ---------------------------------------------------------------- Spark


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def set_edges(rows: DataFrame, bins: Mapping[int, int]) -> dict[int, list[np.ndarray]]:
    """Quantiles of each feature over a set's training rows: at most ``bins[set] - 1`` edges per feature, whatever the number of rows."""
    out: dict[int, list[np.ndarray]] = {}
    values = rows.filter("train").select("set", F.posexplode("features").alias("f", "x"))
    for most in sorted(set(bins.values())):
        sets = [s for s, b in bins.items() if b == most]
        places = F.array(*[F.lit(i / most) for i in range(1, most)])
        found = values.filter(F.col("set").isin(sets)).groupBy("set", "f").agg(F.percentile_approx("x", places, F.lit(max(10_000, 4 * most))).alias("e"))
        for r in stage(found, "edges").toLocalIterator():
            held = out.setdefault(r.set, [])
            held += [np.empty(0)] * (r.f + 1 - len(held))
            held[r.f] = np.unique(np.array(r.e, float))
    return out


#: Features that one task sorts for their edges.
EDGE_FEATURES = 8


def exact_edges(rows: DataFrame, bins: Mapping[int, int]) -> dict[int, list[np.ndarray]]:
    """As :func:`set_edges`, of sets of which a task can hold some features: their values are sorted."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("set").to_numpy()
            for s in np.unique(sets).tolist():
                x = matrix_of(batch.column("features").take(pa.array(np.flatnonzero(sets == s)))).T
                starts = range(0, len(x), EDGE_FEATURES)
                blocks = [np.ascontiguousarray(x[a : a + EDGE_FEATURES]).tobytes() for a in starts]
                n = np.full(len(blocks), x.shape[1], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([(s << 24) + a for a in starts], pa.int64()), pa.array(n), pa.array(blocks, pa.binary())], names=["at", "n", "held"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, table in by_key(batches, "at"):
            s, first = at >> 24, at & (1 << 24) - 1
            parts = [np.frombuffer(v, float).reshape(-1, n) for v, n in zip(table.column("held").to_pylist(), table.column("n").to_pylist())]
            values = np.sort(np.concatenate(parts, 1), axis=1)
            n, most = values.shape[1], bins[s]
            ranks = [math.ceil(i / most * n) - 1 for i in range(1, most)]
            found = [np.unique(v[ranks]) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * len(found), pa.int32()), pa.array(range(first, first + len(found)), pa.int32()), pa.array([e.tolist() for e in found], pa.list_(pa.float64()))],
                names=["set", "f", "e"],
            )

    cores = rows.sparkSession.sparkContext.defaultParallelism
    sent = rows.filter("train").filter(F.col("set").isin(sorted(bins))).select("set", "features").mapInArrow(send, "at bigint, n int, held binary")
    dealt = sent.repartition(4 * cores, "at").sortWithinPartitions("at")
    out: dict[int, list[np.ndarray]] = {}
    for r in stage(dealt.mapInArrow(find, "set int, f int, e array<double>"), "edges").toLocalIterator():
        held = out.setdefault(r.set, [])
        held += [np.empty(0)] * (r.f + 1 - len(held))
        held[r.f] = np.array(r.e, float)
    return out


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(keys))):
            if held and keys[a] != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)


def fit_by_levels(rows: DataFrame, jobs: Mapping[int, tuple[int, TreeSpec]], edges: dict[int, list[np.ndarray]], finish_cells: int = 0) -> dict[int, TreeModel]:
    """Fit jobs on sets of any size, one pass over the rows per level (and round) until nodes have at most ``finish_cells`` values; see the module's text."""
    if not jobs:
        return {}
    context = rows.sparkSession.sparkContext
    counts: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("set", "label").count().collect():
        counts.setdefault(r.set, {})[r.label] = r["count"]
    plans = {}
    for job, (s, spec) in jobs.items():
        n = np.array([counts[s].get(c, 0) for c in range(spec.n_classes)], float)
        factor = class_factors(spec, n)
        start = start_of(spec, n * factor) if spec.kind == "boost" else np.zeros(1)
        plans[job] = (s, spec, factor, start, job_edges(edges[s], spec.bins))
    models = {job: TreeModel(spec, start, []) for job, (_, spec, _, start, _) in plans.items()}
    fixed = context.broadcast(plans)
    rows = rows.withColumn("base", F.array().cast("array<double>"))
    turn = since = 0
    while True:
        # the trees that grow in this turn: all of a tree or a forest, one round of boosting
        growing: dict[tuple[int, int], Tree | None] = {}
        for job, (_, spec, *_) in plans.items():
            if spec.kind == "boost":
                if turn < spec.n_trees:
                    growing |= {(job, turn * spec.outputs + k): None for k in range(spec.outputs)}
            elif turn == 0:
                growing |= {(job, i): None for i in range(spec.n_trees)}
        if not growing:
            return models
        done = context.broadcast((since, {j: m for j, m in models.items() if m.spec.kind == "boost"}))
        if turn - since == KEPT_ROUNDS:
            rows = stage(_with_margins(rows, fixed, done), "margins")
            since = turn
            done = context.broadcast((since, done.value[1]))
        while any(t is None or len(t.open) for t in growing.values()):
            _grow_level(rows, growing, fixed, done)
            for (job, _), tree in growing.items():
                tree.put_off(finish_cells / max(1, len(plans[job][4])))
        if any(len(t.waiting) for t in growing.values()):
            _finish(rows, growing, fixed, done)
        for (job, number), tree in sorted(growing.items()):
            cuts = thresholds(plans[job][4], tree.feature, tree.bin)
            models[job].trees.append((tree.feature, cuts, tree.left, tree.values()))
        turn += 1


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``PASS_CELLS`` values, as every batch may yield sums of every tree."""
    held, cells = [], 0
    for batch in batches:
        held.append(batch)
        cells += len(batch.column("features").flatten())
        if cells >= PASS_CELLS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, cells = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _seen(batches: Iterator[pa.RecordBatch], of_set: dict[int, list[int]], names: list, trees: list, plans: dict, since: int, models: dict) -> Iterator[tuple]:
    """Of every batch and tree that grows: the tree, its job's specification, the bins, nodes, statistics and hashes of the rows, and the edges."""
    for batch in _larger(batches):
        sets, label_of, row_of = (batch.column(c).to_numpy() for c in ("set", "label", "row"))
        for s in np.unique(sets).tolist():
            if s not in of_set:
                continue
            at = np.flatnonzero(sets == s)
            x, label, row = matrix_of(batch.column("features").take(pa.array(at))), label_of[at], row_of[at]
            base = matrix_of(batch.column("base").take(pa.array(at)))
            cells: dict[int, np.ndarray] = {}
            margins: dict[int, np.ndarray] = {}
            for t in of_set[s]:
                job, number = names[t]
                _, spec, factor, _, edges = plans[job]
                if spec.bins not in cells:
                    cells[spec.bins] = binned(x, edges)
                own = cells[spec.bins]
                margin = None
                if spec.kind == "boost":
                    if job not in margins:
                        margins[job] = _margins(plans, models, since, job, x, base)
                    margin = margins[job]
                stats = statistics(spec, label, row_weights(spec, number // spec.outputs, row), factor, margin, number % spec.outputs)
                leaf = np.zeros(len(x), np.int64) if trees[t] is None else trees[t].leaves_of(own)
                yield t, spec, own, leaf, stats, row, edges


def _finish(rows: DataFrame, growing: dict[tuple[int, int], Tree], fixed, done) -> None:
    """One pass for all nodes that a task can hold: their rows, as bins and statistics, go to a task each, which grows the rest of the tree below."""
    names = sorted(growing)
    trees = [growing[k] for k in names]
    level = rows.sparkSession.sparkContext.broadcast((names, trees))
    of_set: dict[int, list[int]] = {}
    for t, (job, _) in enumerate(names):
        if len(trees[t].waiting):
            of_set.setdefault(fixed.value[job][0], []).append(t)

    def kind_of(edges: list[np.ndarray]) -> type:
        return np.uint8 if max(len(e) for e in edges) < 256 else np.uint16

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, trees = level.value
        plans, (since, models) = fixed.value, done.value
        for t, _, own, leaf, stats, row, edges in _seen(batches, of_set, names, trees, plans, since, models):
            waits = np.zeros(len(trees[t].feature), bool)
            waits[trees[t].waiting] = True
            use = np.flatnonzero(waits[leaf] & (stats[:, -1] > 0))
            if not len(use):
                continue
            bins, sums = own[use].astype(kind_of(edges)), np.ascontiguousarray(stats[use], float)
            values = np.hstack([bins.view(np.uint8).reshape(len(use), -1), sums.view(np.uint8).reshape(len(use), -1)])
            ends = np.arange(len(use) + 1, dtype=np.int32) * values.shape[1]
            held = pa.Array.from_buffers(pa.binary(), len(use), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array((t << 31) + leaf[use].astype(np.int64)), pa.array(row[use]), held], names=["at", "row", "held"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, trees = level.value
        for at, table in by_key(batches, "at"):
            t, node = at >> 31, at & (1 << 31) - 1
            job, number = names[t]
            _, spec, _, _, edges = fixed.value[job]
            held = np.frombuffer(b"".join(table.column("held").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            width = len(edges) * np.dtype(kind_of(edges)).itemsize
            bins = np.ascontiguousarray(held[:, :width]).view(kind_of(edges))
            stats = np.ascontiguousarray(held[:, width:]).view(float)
            below = grow_here(spec, number, bins.astype(np.int64), stats, int(trees[t].number[node]), int(trees[t].level[node]))
            parts = pickle.dumps((below.feature, below.bin, below.left, below.stats))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([parts], pa.binary())], names=["at", "tree"])

    sent = rows.mapInArrow(send, "at bigint, row bigint, held binary")
    dealt = sent.repartition("at").sortWithinPartitions("at", "row", "held")
    for r in stage(dealt.mapInArrow(grow, "at bigint, tree binary"), "subtrees").toLocalIterator():
        trees[r.at >> 31].graft(r.at & (1 << 31) - 1, *pickle.loads(r.tree))
    for tree in trees:
        tree.waiting = np.empty(0, np.int32)
    level.unpersist()


def _grow_level(rows: DataFrame, growing: dict[tuple[int, int], Tree | None], fixed, done) -> None:
    """One pass: sums per (tree, node, feature, bin), then the best split of each open node of each tree."""
    names = sorted(growing)
    trees = [growing[k] for k in names]
    channels = max(fixed.value[j][1].channels for j, _ in names)
    level = rows.sparkSession.sparkContext.broadcast((names, trees))
    of_set: dict[int, list[int]] = {}
    for t, (job, _) in enumerate(names):
        if trees[t] is None or len(trees[t].open):
            of_set.setdefault(fixed.value[job][0], []).append(t)
    sums = [f"s{c}" for c in range(channels)]
    schema = "t int, node int, f int, b int, " + ", ".join(f"{c} double" for c in sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, trees = level.value
        plans, (since, models) = fixed.value, done.value
        held: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for t, table in held.items():
                node, f, b = np.nonzero(table[..., -1])
                values = table[node, f, b]
                columns = [pa.array(np.full(len(node), t, np.int32)), *[pa.array(c.astype(np.int32)) for c in (node, f, b)]]
                # the number of rows is the last channel whatever the number of classes
                columns += [pa.array(values[:, c]) if c < values.shape[1] - 1 else pa.array(values[:, -1] if c == channels - 1 else np.zeros(len(node))) for c in range(channels)]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "node", "f", "b", *sums])
            held.clear()

        for t, spec, own, leaf, stats, _, edges in _seen(batches, of_set, names, trees, plans, since, models):
            tree = trees[t]
            slot = leaf
            if tree is not None:
                place = np.full(len(tree.feature), -1)
                place[tree.open] = np.arange(len(tree.open))
                slot = place[leaf]
            use = np.flatnonzero((slot >= 0) & (stats[:, -1] > 0))
            nodes = 1 if tree is None else len(tree.open)
            width, bins = own.shape[1], max(len(e) for e in edges) + 1
            size = nodes * width * bins * spec.channels
            if sum(h.size for h in held.values()) + size > HELD:
                yield from flush()
            table = held.get(t)
            if table is None:
                table = held[t] = np.zeros((nodes, width, bins, spec.channels))
            index = ((slot[use, None] * width + np.arange(width)) * bins + own[use]).ravel()
            for c in range(spec.channels):
                table[..., c] += np.bincount(index, np.repeat(stats[use, c], width), nodes * width * bins).reshape(nodes, width, bins)
        yield from flush()

    merged = rows.mapInArrow(add, schema).groupBy("t", "node", "f", "b").agg(*[F.sum(c).alias(c) for c in sums])
    # a node has at most features * bins rows; each node's features are compared in one task
    dealt = merged.withColumn("at", F.col("t").cast("bigint") * (1 << 31) + F.col("node")).repartition("at").sortWithinPartitions("at", "f", "b")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, trees = level.value
        for at, table in by_key(batches, "at"):
            t, node = at >> 31, at & (1 << 31) - 1
            job, number = names[t]
            spec = fixed.value[job][1]
            yield _choice(spec, number, t, node, trees[t], table, sums)

    out = "t int, node int, f int, b int, sides array<double>, total array<double>"
    best = stage(dealt.mapInArrow(choose, out), "splits").toArrow().to_pylist()
    level.unpersist()
    by_tree: dict[int, list[dict]] = {}
    for r in best:
        by_tree.setdefault(r["t"], []).append(r)
    for t, name in enumerate(names):
        if trees[t] is not None and not len(trees[t].open):
            continue
        spec = fixed.value[name[0]][1]
        found = sorted(by_tree.get(t, []), key=lambda r: r["node"])
        if trees[t] is None:
            total = np.array(found[0]["total"]) if found else np.zeros(spec.channels)
            growing[name] = Tree(spec, total)
            if not len(growing[name].open):
                continue
        tree = growing[name]
        good = [r for r in found if r["f"] >= 0]
        nodes = tree.open[[r["node"] for r in good]] if good else np.empty(0, np.int32)
        left = np.array([r["sides"] for r in good]).reshape(len(good), spec.channels)
        tree.split(nodes, np.array([r["f"] for r in good], np.int32), np.array([r["b"] for r in good], np.int64), left)


def _margins(plans: dict, models: dict[int, TreeModel], since: int, job: int, x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """A boosting job's margins: those kept with the rows after ``since`` rounds, and what later trees add."""
    model, outputs = models[job], models[job].spec.outputs
    if base.shape[1]:
        at = sum(models[j].spec.outputs for j in sorted(models) if j < job and plans[j][0] == plans[job][0])
        margin = base[:, at : at + outputs].copy()
    else:
        margin = np.repeat(model.start[None, :], len(x), axis=0)
    for i in range(since * outputs, len(model.trees)):
        f, cut, left, value = model.trees[i]
        margin[:, i % outputs] += value[route(f, cut, left, x), 0]
    return margin


def _with_margins(rows: DataFrame, fixed, done) -> DataFrame:
    """The rows with the margins of all boosting jobs of their set, in the order of the jobs, as ``base``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, (since, models) = fixed.value, done.value
        for batch in batches:
            sets = batch.column("set").to_numpy()
            out: list = [None] * batch.num_rows
            for s in np.unique(sets).tolist():
                at = np.flatnonzero(sets == s)
                x, base = (matrix_of(batch.column(c).take(pa.array(at))) for c in ("features", "base"))
                parts = [_margins(plans, models, since, j, x, base) for j in sorted(models) if plans[j][0] == s]
                for i, row in zip(at, np.hstack(parts) if parts else np.empty((len(at), 0))):
                    out[i] = row
            columns = [pa.array(out, pa.list_(pa.float64())) if n == "base" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _choice(spec: TreeSpec, number: int, t: int, node: int, tree: Tree | None, table: pa.Table, sums: list[str]) -> pa.RecordBatch:
    """The best split of one node from its sums per feature and bin."""
    f, b = (table.column(c).to_numpy() for c in ("f", "b"))
    used = [*sums[: spec.channels - 1], sums[-1]]
    s = np.stack([table.column(c).to_numpy() for c in used], 1)
    total = s[f == f[0]].sum(0)
    features = tree_features(spec, number, int(f.max()) + 1)
    dense = np.zeros((int(f.max()) + 1, int(b.max()) + 1, spec.channels))
    dense[f, b] = s
    dense = dense[features]
    left = dense.cumsum(1)
    gain = gains(spec, left, total[None, None])
    gain[dense[..., -1] == 0] = -np.inf  # the same rows as the cut before
    where = np.array([1 if tree is None else tree.number[tree.open[node]]])
    if spec.random_split:
        filled = dense[..., -1] > 0
        low, high = filled.argmax(1), filled.shape[1] - 1 - filled[:, ::-1].argmax(1)
        limit = low + np.floor(draws(spec.seed, 6, number, where[None, :], features[:, None])[:, 0] * (high - low)).astype(int)
        last = np.where(filled & (np.arange(filled.shape[1]) <= limit[:, None]), np.arange(filled.shape[1]), -1).max(1)
        gain[np.arange(gain.shape[1]) != last[:, None]] = -np.inf
    best = gain.max(1)
    tried = node_features(spec, number, where, features)
    if tried is not None:
        best[~tried[:, 0]] = -np.inf
    score = noisy(spec, number, where, features, best[:, None])[:, 0]
    k = int(score.argmax())
    good = bool(np.isfinite(score[k]))
    cut = int(gain[k].argmax()) if good else 0
    return pa.RecordBatch.from_arrays(
        [
            pa.array([t], pa.int32()), pa.array([node], pa.int32()), pa.array([int(features[k]) if good else -1], pa.int32()), pa.array([cut], pa.int32()),
            pa.array([left[k, cut].tolist()], pa.list_(pa.float64())), pa.array([total.tolist()], pa.list_(pa.float64())),
        ],
        names=["t", "node", "f", "b", "sides", "total"],
    )
