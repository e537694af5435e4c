"""Importance of search parameters by functional analysis of variance over a forest.

A tree is constant on boxes of the search space.  The variance of its marginal over one parameter, all others integrated out, is summed exactly over
the boxes; its share of the tree's whole variance, averaged over the trees, is the parameter's importance.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Domain:
    """Where a parameter is drawn from: evenly from ``values``, or from between ``low`` and ``high``."""

    values: tuple[float, ...] = ()
    low: float = 0.0
    high: float = 1.0

    def measure(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The share of the domain that lies above ``low`` and not above ``high``."""
        if self.values:
            values = np.array(self.values)
            return (np.searchsorted(values, high, "right") - np.searchsorted(values, low, "right")) / len(values)
        if self.high <= self.low:
            return ((low < self.low) & (self.low <= high)).astype(float)
        return np.maximum(0.0, np.minimum(high, self.high) - np.maximum(low, self.low)) / (self.high - self.low)


def leaf_boxes(nodes: Sequence[Mapping], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper bounds per leaf and parameter, and the leaves' values, of one tree.

    ``nodes`` have ``id, feature`` (-1 at a leaf)``, threshold, left, right, value``; the root is node 0.
    """
    by_id = {n["id"]: n for n in nodes}
    lows, highs, values = [], [], []
    waiting = [(0, np.full(width, -math.inf), np.full(width, math.inf))]
    while waiting:
        number, low, high = waiting.pop()
        node = by_id[number]
        if node["feature"] < 0:
            lows.append(low)
            highs.append(high)
            values.append(node["value"])
            continue
        f, t = node["feature"], node["threshold"]
        left, right = high.copy(), low.copy()
        left[f], right[f] = min(high[f], t), max(low[f], t)
        waiting += [(node["left"], low, left), (node["right"], right, high)]
    return np.array(lows), np.array(highs), np.array(values, float)


def marginal_shares(low: np.ndarray, high: np.ndarray, value: np.ndarray, domains: Sequence[Domain]) -> np.ndarray:
    """Share of a tree's variance that each parameter explains alone; zeros for a constant tree."""
    parts = np.stack([d.measure(low[:, j], high[:, j]) for j, d in enumerate(domains)], 1)
    volume = parts.prod(1)
    mean = (value * volume).sum()
    whole = (value**2 * volume).sum() - mean**2
    out = np.zeros(len(domains))
    if whole <= 1e-15 * max(1.0, float((value**2).max(initial=0))):
        return out
    for j, domain in enumerate(domains):
        others = np.delete(parts, j, 1).prod(1) * value
        # the marginal is constant between neighbouring bounds
        cuts = np.unique(np.concatenate([low[:, j], high[:, j]]))
        size = domain.measure(cuts[:-1], cuts[1:])
        first, last = np.searchsorted(cuts, low[:, j]), np.searchsorted(cuts, high[:, j])
        steps = np.zeros(len(cuts))
        np.add.at(steps, first, others)
        np.add.at(steps, last, -others)
        marginal = steps.cumsum()[:-1]
        out[j] = max(0.0, ((marginal - mean) ** 2 * size).sum()) / whole
    return out
