"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to unit length and rotated, and their dimensions cut into blocks.  If two unit vectors are within the squared
distance of the threshold, then in at least one block they are within the block's proportional share of it.  Each block is a range
join on a grid of cells; the union of its candidates is verified exactly on the whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import components
from labelweave.llm.pairing import CHUNK, Groups, deal_chunks, deal_pairs, map_groups
from labelweave.runtime import stage

#: Dimensions of a block, and how many of them span the grid.
BLOCK_DIMS, GRID_DIMS = 8, 4
#: Side of a cell as a multiple of a block's radius.
CELL = 3.0
#: Room for rounding in squared block distances.
ROOM = 1e-9


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _unit(rows: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _blocks(d: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, d)) for a in range(0, d, BLOCK_DIMS)]


def _squared_limit(threshold: float) -> float:
    return 2.0 - 2.0 * threshold


def _mixed(values: np.ndarray) -> np.ndarray:
    """One 64-bit key of the rows of an integer matrix."""
    out = np.full(len(values), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(values.shape[1]):
        out = (out ^ values[:, k].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def cell_records(classes: DataFrame, threshold: float) -> DataFrame:
    """``cell, cls, block, own, part``: each vector in its own cell of every block, and as a visitor in those
    neighbouring cells, of larger coordinates only, that its ball reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                vectors = [np.array(v, float) for v in some.column("embedding").to_pylist()]
                label, cls = some.column("label").to_numpy(), some.column("cls").to_numpy()
                for d in sorted({len(v) for v in vectors}):
                    rows = np.array([i for i, v in enumerate(vectors) if len(v) == d])
                    yield from records(np.array([vectors[i] for i in rows]), label[rows], cls[rows], d)

    def records(x, label, cls, d):
        x = _unit(x) @ rotation(d)
        blocks = _blocks(d)
        for b, where in enumerate(blocks):
            part = x[:, where]
            limit = _squared_limit(threshold) * part.shape[1] / d
            g = min(GRID_DIMS, part.shape[1])
            side = CELL * np.sqrt(limit)
            scaled = part[:, :g] / side
            cell = np.floor(scaled).astype(np.int64)
            low = (scaled - cell) * side
            high = side - low
            head = np.stack([label.astype(np.int64), np.full(len(x), d), np.full(len(x), b)], 1)
            keys, who, own = [_mixed(np.hstack([head, cell]))], [np.arange(len(x))], [np.ones(len(x), bool)]
            for offset in product((-1, 0, 1), repeat=g):
                if offset <= (0,) * g:
                    continue
                reach = sum((low[:, k] if o < 0 else high[:, k]) ** 2 for k, o in enumerate(offset) if o)
                at = np.flatnonzero(reach <= limit + ROOM)
                if len(at):
                    keys.append(_mixed(np.hstack([head[at], cell[at] + np.array(offset)])))
                    who.append(at)
                    own.append(np.zeros(len(at), bool))
            rows = np.concatenate(who)
            data = [p.tobytes() for p in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys)), pa.array(cls[rows]), pa.array(np.full(len(rows), b, np.int32)),
                    pa.array(np.concatenate(own)), pa.array([data[i] for i in rows], pa.binary()),
                ],
                names=["cell", "cls", "block", "own", "part"],
            )

    return classes.select("label", "cls", "embedding").mapInArrow(run, "cell bigint, cls bigint, block int, own boolean, part binary")


def _pair_mask(table: pa.Table) -> np.ndarray:
    """Which rows of a group are compared: owners with owners and visitors, once; across the sides if there are two."""
    own, side = table.column("own").to_numpy(), table.column("side").to_numpy()
    mask = np.triu(own[:, None] | own[None, :], 1)
    if side.any():
        mask &= side[:, None] != side[None, :]
    return mask


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector.

    Vectors of one label are linked when their cosine, in double precision, is at least ``threshold``.  A vector
    links with nothing when it or its label is null, or when it is empty, zero, or holds a null or non-finite component; vectors of
    different lengths are never linked.  Rows that repeat an id are vectors of their own; equal vectors are compared as one and counted
    with their number.  A null id is no component's smallest unless it stands alone.  Other columns are ignored.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    cls = F.when(valid, F.xxhash64(F.col("label").cast("bigint"), e))
    named = vectors.select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding", cls.alias("cls"))
    known = named.filter("cls IS NOT NULL")
    classes = stage(
        known.groupBy("cls").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least_id"), F.count("*").alias("copies")),
        "vectors",
    )
    records = stage(cell_records(classes, threshold), "cells")
    counts = stage(
        records.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("owned")).filter("n > 1 AND owned").select("cell", "n"), "cell_counts"
    )
    met = records.join(counts.select("cell"), "cell", "left_semi")
    pairs = deal_pairs(deal_chunks(met, ["cell"], F.xxhash64("cls"), counts))

    def narrow(table: pa.Table):
        part = np.frombuffer(b"".join(table.column("part").to_pylist()), float).reshape(table.num_rows, -1)
        share = part.shape[1]
        square = (part**2).sum(1)
        distance = square[:, None] + square[None, :] - 2 * part @ part.T
        limit = limits[share]
        close = (distance <= limit + 2 * ROOM) & _pair_mask(table)
        rows = np.flatnonzero(close.any(0) | close.any(1))
        return table.select(["cell", "i", "j", "cls", "block", "own", "side"]).take(pa.array(rows)) if len(rows) else None

    # a block's width tells its largest share, that of the shortest vectors with such a block; blocks of other vector lengths
    # have other cells.  One row per width
    size = F.size("embedding")
    widths = F.array_distinct(F.filter(F.array(F.least(size, F.lit(BLOCK_DIMS)), size % BLOCK_DIMS), lambda w: w > 0))
    shortest = classes.select(size.alias("d"), F.explode(widths).alias("width")).groupBy("width").agg(F.min("d").alias("d")).collect()
    limits = {r.width: _squared_limit(threshold) * r.width / r.d for r in shortest}
    found = map_groups(pairs, ["cell", "i", "j"], narrow, "cell bigint, i int, j int, cls bigint, block int, own boolean, side int")
    full = stage(found, "candidates").join(classes.select("cls", "embedding", "copies"), "cls")

    def verify(table: pa.Table):
        x = _unit(np.array(table.column("embedding").to_pylist(), float))
        cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        order = np.argsort(cls, kind="stable")
        cosine = x @ x.T
        linked = (cosine >= threshold) & _pair_mask(table)
        a, b = np.nonzero(linked)
        turned = x @ rotation(x.shape[1])
        block = int(table.column("block")[0].as_py())
        first = np.ones(len(a), bool)
        for k, where in enumerate(_blocks(x.shape[1])[: block + 1]):
            near = ((turned[a, where] - turned[b, where]) ** 2).sum(1) <= _squared_limit(threshold) * (where.stop - where.start) / x.shape[1] + ROOM
            # the first block in which a pair is near reports it
            first &= ~near if k < block else near
        a, b = a[first], b[first]
        if not len(a):
            return None
        n = np.bincount(a, copies[b], len(cls)) + np.bincount(b, copies[a], len(cls))
        groups = Groups(len(cls))
        kept = [(cls[i], cls[j]) for i, j in zip(a.tolist(), b.tolist()) if groups.join(i, j)]
        some = [i for i in order if n[i]]
        return pa.table(
            {
                "a": pa.array([cls[i] for i in some] + [k[0] for k in kept], pa.int64()),
                "b": pa.array([None] * len(some) + [k[1] for k in kept], pa.int64()),
                "n": pa.array([int(n[i]) for i in some] + [0] * len(kept), pa.int64()),
            }
        )

    links = stage(map_groups(full, ["cell", "i", "j"], verify, "a bigint, b bigint, n bigint"), "vector_links")
    number = links.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    parts = components(links.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("vertex", "cls")
    least = classes.join(parts, "cls").groupBy("component").agg(F.min("least_id").alias("least_of"))
    reach = parts.join(least, "component").select("cls", "least_of")
    own = classes.select("cls", "least_id", "copies").join(reach, "cls", "left").join(number, "cls", "left")
    own = own.select("cls", F.coalesce("least_of", "least_id").alias("least_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    out = named.select("vec_id", "cls").join(stage(own, "named"), "cls", "left")
    component = F.coalesce("least_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
    )
