"""Exact k-nearest-neighbour join.

Points are assigned to the nearest of a bounded set of pivots (cells), and the queries of neighbouring
cells make up strips of bounded size; a cell that holds a third of all points becomes many strips.
Triangle-inequality bounds between cells decide which cells can hold neighbours of which, and only those are
sent to a strip.  A task holds the queries of a strip and their best ``k`` neighbours so far, and the points stream past
them, nearest cells first, in blocks for a vectorised kernel; so a point is shuffled once per strip, not once per
pair of blocks, and only the answers leave the task.  The result is exact: bounds only skip cells that
cannot contribute.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.functions.hashing import hash_hex
from labelweave.operators.ordering import first_rows
from labelweave.runtime import stage

BLOCK_ROWS = 1024
MAX_PIVOTS = 128
#: Coordinates of the queries that a task holds, in bytes, and the fewest queries worth a task.
STRIP_BYTES, MIN_STRIP_ROWS = 32 << 20, 256
#: Points that a strip meets at once, distances computed at once, candidates measured exactly at once, and queries whose sums fit a core's cache.
STEP_ROWS, STEP_CELLS, CANDIDATES, TILE_ROWS = 1024, 1 << 21, 1 << 16, 64


def pairwise(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Minkowski distances between the rows of two small matrices."""
    gap = np.abs(a[:, None, :] - b[None, :, :])
    return gap.sum(-1) if p == 1 else np.sqrt((gap**2).sum(-1))


def _nearest_pivot(vectors: np.ndarray, pivots: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    cells, gaps = [], []
    rows = max(1, 4_000_000 // max(1, pivots.size))
    for start in range(0, len(vectors), rows):
        d = pairwise(vectors[start : start + rows], pivots, p)
        best = d.argmin(1)
        cells.append(best)
        gaps.append(d[np.arange(len(best)), best])
    return np.concatenate(cells), np.concatenate(gaps)


def _assign(df: DataFrame, pivots: np.ndarray, p: int) -> DataFrame:
    """Adds the cell of every point and its distance to the cell's pivot."""
    schema = T.StructType(
        [*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cells, gaps = _nearest_pivot(np.stack(batch["features"].to_numpy()), pivots, p)
                yield batch.assign(cell=cells.astype("int32"), gap=gaps)

    return stage(df.mapInPandas(run, schema), "cells")


class _Strip:
    """Queries held by a task, with the best ``k`` neighbours by (distance, id) that they have met so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, cells: np.ndarray, k: int, p: int, exclude_self: bool):
        self.ids, self.x, self.cells, self.k, self.p, self.exclude_self = ids, x, cells, k, p, exclude_self
        self.distance = np.full((len(x), k), np.inf)
        self.near = np.empty((len(x), k), ids.dtype)

    def meet(self, rows: np.ndarray, d_ids: np.ndarray, d: np.ndarray) -> None:
        """Compare the queries ``rows`` with a block of points."""
        step = max(1, STEP_CELLS // len(d))
        for start in range(0, len(rows), step):
            at = rows[start : start + step]
            limit = self.distance[at, -1]
            near, slack = _about(self.x[at], d, self.p)
            bound = (limit**2 if self.p == 2 else limit) + slack
            fresh = np.flatnonzero(np.isinf(limit))
            need = self.k + self.exclude_self
            if len(fresh) and len(d) >= need:
                bound[fresh] = np.partition(near[fresh], need - 1, axis=1)[:, need - 1] + 2 * slack[fresh]
            # what cannot be compared here is left to the exact distance
            r, c = np.nonzero(~(near > bound[:, None]))
            for piece in range(0, len(r), CANDIDATES):
                self._merge(at, limit, r[piece : piece + CANDIDATES], c[piece : piece + CANDIDATES], d_ids, d)

    def _merge(self, at: np.ndarray, limit: np.ndarray, r: np.ndarray, c: np.ndarray, d_ids: np.ndarray, d: np.ndarray) -> None:
        gap = np.abs(self.x[at[r]] - d[c])
        distance = gap.sum(1) if self.p == 1 else np.sqrt((gap**2).sum(1))
        keep = np.isfinite(distance) & (distance <= limit[r])
        if self.exclude_self:
            keep &= self.ids[at[r]] != d_ids[c]
        r, c, distance = r[keep], c[keep], distance[keep]
        if not len(r):
            return
        touched = np.unique(r)
        held = np.isfinite(self.distance[at[touched]])
        row = np.concatenate([np.repeat(touched, held.sum(1)), r])
        distance = np.concatenate([self.distance[at[touched]][held], distance])
        near = np.concatenate([self.near[at[touched]][held], d_ids[c]])
        place = np.unique(near, return_inverse=True)[1] if near.dtype == object else near
        order = np.lexsort((place, distance, row))
        row, distance, near = row[order], distance[order], near[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < self.k
        self.distance[at[row[best]], rank[best]] = distance[best]
        self.near[at[row[best]], rank[best]] = near[best]

    def result(self, id_type: pa.DataType) -> pa.RecordBatch:
        rows, rank = np.nonzero(np.isfinite(self.distance))
        columns = [pa.array(self.ids[rows], id_type), pa.array(self.near[rows, rank], id_type), pa.array(self.distance[rows, rank]), pa.array(rank.astype(np.int32) + 1)]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "neighbor_id", "distance", "rank"])


def _about(q: np.ndarray, d: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Fast distances (squared ones for ``p`` 2) between all rows, and for each row of ``q`` more than their error."""
    if p == 2:
        own, norms = (q**2).sum(1), (d**2).sum(1)
        near = q @ (-2.0 * d.T)
        near += norms
        near += own[:, None]
        return near, 1e-9 * (own + norms.max())
    size = np.abs(q).sum(1) + np.abs(d).sum(1).max()
    # single precision where nothing can overflow; the sums stay in a core's cache
    single = size.max(initial=0.0) < 1e30
    kind, unit, least = (np.float32, 2.0**-22, 1e-35) if single else (np.float64, 2.0**-50, 0.0)
    near, q, columns = np.zeros((len(q), len(d)), kind), q.astype(kind), np.ascontiguousarray(d.T, kind)
    gap = np.empty((TILE_ROWS, len(d)), kind)
    for start in range(0, len(q), TILE_ROWS):
        part, total = q[start : start + TILE_ROWS], near[start : start + TILE_ROWS]
        one = gap[: len(part)]
        for j, column in enumerate(columns):
            np.subtract(part[:, j : j + 1], column, out=one)
            np.abs(one, out=one)
            total += one
    return near, (q.shape[1] + 4) * (unit * size + least)


def _met(batches: Iterator[pa.RecordBatch], groups: list[str], k: int, p: int, exclude_self: bool, wanted=None) -> Iterator[pa.RecordBatch]:
    """The best of every group of rows ``groups, turn, cell, id, features`` sorted by groups and turn: turn 0 has the queries, later ones the points.

    ``wanted(strip, cell)`` says which queries have to be compared with the points of a cell.
    """
    group = strip = id_type = None
    held: list[pa.RecordBatch] = []

    def queries() -> _Strip:
        table = pa.Table.from_batches(held).combine_chunks()
        return _Strip(_ids(table.column("id")), _matrix(table.column("features")), table.column("cell").to_numpy(), k, p, exclude_self)

    def compare() -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, x = _ids(table.column("id")), _matrix(table.column("features"))
        for start in range(0, len(ids), STEP_ROWS):
            rows = np.arange(len(strip.ids)) if wanted is None else wanted(strip, table.column("cell")[0].as_py())
            if len(rows):
                strip.meet(rows, ids[start : start + STEP_ROWS], x[start : start + STEP_ROWS])

    turn = None
    for batch in batches:
        if not batch.num_rows:
            continue
        id_type = batch.schema.field("id").type
        keys = np.stack([batch.column(c).to_numpy() for c in (*groups, "turn")], 1)
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        for a, b in zip(starts, np.append(starts[1:], len(keys))):
            now = tuple(keys[a].tolist())
            if held and (now != turn or (turn[-1] > 0 and sum(h.num_rows for h in held) >= STEP_ROWS)):
                if turn[-1] == 0:
                    strip = queries()
                elif strip is not None:
                    compare()
                held = []
            if now[:-1] != group:
                if strip is not None:
                    yield strip.result(id_type)
                group, strip = now[:-1], None
            turn = now
            held.append(batch.slice(a, b - a))
    if held and turn[-1] == 0:
        strip = queries()
    elif held and strip is not None:
        compare()
    if strip is not None:
        yield strip.result(id_type)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _strip_plan(
    q_stats: dict, d_stats: dict, gaps: dict[int, list[float]], between: np.ndarray, need: int, strip_rows: int
) -> tuple[np.ndarray, list[tuple[int, list[int]]], list[tuple[int, int, int]], int]:
    """Which cells can hold neighbours of which, the strips of each cell's queries, the cells that each strip meets and in what turn, and the number of strips."""
    allowed = np.zeros(between.shape, bool)
    for i, query in q_stats.items():
        upper = np.sort(np.concatenate([query.radius + between[i, j] + np.array(g) for j, g in gaps.items()]))
        reach = upper[need - 1] if len(upper) >= need else np.inf
        for j, cell in d_stats.items():
            allowed[i, j] = between[i, j] - query.radius - cell.radius <= reach * (1 + 1e-9) + 1e-9
    # neighbouring cells share a strip
    left, order = set(q_stats), []
    while left:
        order.append(min(left, key=lambda c: (between[order[-1], c] if order else 0.0, c)))
        left.remove(order[-1])
    strips, members, strip, filled = [], {}, 0, 0
    for c in order:
        parts = -(-q_stats[c].n // strip_rows)
        size, of_cell = -(-q_stats[c].n // parts), []
        for _ in range(parts):
            if filled and filled + size > strip_rows:
                strip, filled = strip + 1, 0
            filled += size
            of_cell.append(strip)
            members.setdefault(strip, []).append(c)
        strips.append((c, of_cell))
    wants = []
    for s, cells in members.items():
        met = [j for j in d_stats if allowed[cells, j].any()]
        met.sort(key=lambda j: (between[cells, j].min(), j))
        wants += [(s, j, turn + 1) for turn, j in enumerate(met)]
    return allowed, strips, wants, strip + 1


def _checked(points: DataFrame) -> int:
    """Number of points; results are kept by key, so keys must differ, and distances need finite numbers."""
    bad = F.coalesce(F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))), F.lit(True))
    facts = points.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(bad).alias("bad")).first()
    if facts.ids != facts.n or facts.bad:
        raise ValueError("points need different keys, none null, and finite coordinates")
    return facts.n


def knn_join(
    queries: DataFrame,
    data: DataFrame,
    k: int,
    key: str = "key",
    features: str = "features",
    p: int = 2,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
    seed: int = 42,
) -> DataFrame:
    """``(query_id, neighbor_id, distance, rank)``: the ``k`` nearest points of every query.

    Order is (distance, neighbor id), so the result is deterministic.  ``p`` is 1 or 2.
    """
    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    spark = data.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.col(features).cast("array<double>").alias("features"))

    base = stage(prepared(data), "points")
    id_type = base.schema["id"].dataType
    n_data = _checked(base)
    if queries is not data:
        _checked(prepared(queries))
    result_schema = T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("neighbor_id", id_type),
            T.StructField("distance", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )
    if n_data == 0:
        return spark.createDataFrame([], result_schema)
    # pivots: a bounded number of points in hash order (top-n, no full sort)
    n_pivots = int(min(max_pivots, max(1, -(-n_data // block_rows))))
    chosen = base.orderBy(hash_hex(seed, "id"), "id").select("features").limit(n_pivots).collect()
    pivots = np.array([row.features for row in chosen], dtype=float)
    need = k + 1 if exclude_self else k

    base_cells = _assign(base, pivots, p)
    query_cells = base_cells if queries is data else _assign(prepared(queries), pivots, p)
    # of equal points only the smallest ids can be an answer
    data_cells = stage(first_rows(base_cells, ["features"], ["id"], need), "distinct")

    # cell statistics: at most ``max_pivots`` rows, and k (+1) smallest gaps per cell
    q_stats = {r.cell: r for r in query_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}
    d_stats = {r.cell: r for r in data_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}
    if not q_stats:
        return spark.createDataFrame([], result_schema)
    gaps: dict[int, list[float]] = {}
    for row in first_rows(data_cells.select("cell", "gap", "id"), ["cell"], ["gap", "id"], need).collect():
        gaps.setdefault(row.cell, []).append(row.gap)

    even = -(-sum(r.n for r in q_stats.values()) // (2 * spark.sparkContext.defaultParallelism))
    strip_rows = max(1, min(max(even, MIN_STRIP_ROWS), STRIP_BYTES // (8 * max(1, pivots.shape[1]))))
    between = pairwise(pivots, pivots, p)
    allowed, strips, wants, n_strips = _strip_plan(q_stats, d_stats, gaps, between, need, strip_rows)
    strips = spark.createDataFrame(strips, "cell INT, strips ARRAY<INT>")
    wants = spark.createDataFrame(wants, "strip INT, cell INT, turn INT")
    mine = F.get("strips", F.pmod(F.xxhash64("id"), F.size("strips")).cast("int"))
    asked = query_cells.join(F.broadcast(strips), "cell").select(mine.alias("strip"), F.lit(0).alias("turn"), "cell", F.col("id").cast(id_type).alias("id"), "features")
    offered = data_cells.join(F.broadcast(wants), "cell").select("strip", "turn", "cell", "id", "features")
    radii = np.zeros(len(pivots))
    for c, r in d_stats.items():
        radii[c] = r.radius
    shared = spark.sparkContext.broadcast((pivots, radii, allowed))

    def wanted(strip: _Strip, cell: int) -> np.ndarray:
        """Queries whose distance to the cell is not beyond their neighbours so far."""
        pivots, radii, allowed = shared.value
        rows = np.flatnonzero(allowed[strip.cells, cell])
        away = pairwise(strip.x[rows], pivots[cell : cell + 1], p)[:, 0]
        least = away - radii[cell] - 1e-9 * (1 + away + radii[cell])
        return rows[~(least > strip.distance[rows, -1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _met(batches, ["strip"], k, p, exclude_self, wanted)

    # a strip is a partition, which streams the points past the queries that it holds
    dealt = asked.unionByName(offered).repartitionById(n_strips, F.col("strip")).sortWithinPartitions("strip", "turn")
    return dealt.mapInArrow(run, result_schema)


def _probe_codes(margins: np.ndarray, probes: int) -> np.ndarray:
    """Bucket of every row, then the ``probes`` buckets across the nearest planes, one or two at a time."""
    n, bits = margins.shape
    weights = 1 << np.arange(bits, dtype=np.int64)
    own = (margins > 0) @ weights
    cost = np.abs(margins)
    flips = [(i,) for i in range(bits)] + [(i, j) for i in range(bits) for j in range(i)]
    probes = min(probes, len(flips))
    if not probes:
        return own[:, None]
    price = np.stack([cost[:, list(f)].sum(1) for f in flips], axis=1)
    masks = np.array([weights[list(f)].sum() for f in flips])
    best = np.argpartition(price, probes - 1, axis=1)[:, :probes]
    return np.concatenate([own[:, None], own[:, None] ^ masks[best]], axis=1)


def _hashed(df: DataFrame, planes: np.ndarray, cuts: np.ndarray, probes: int) -> DataFrame:
    """``(id, features, buckets)``, staged; ``buckets`` has one ``(tab, bucket)`` per table and probed bucket."""
    codes = T.ArrayType(T.ArrayType(T.LongType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start : start + 1024]
                vectors = np.stack(part["features"].to_numpy())
                of_table = [_probe_codes(vectors @ planes[t].T - cuts[t], probes) for t in range(len(planes))]
                yield part.assign(codes=[[c[i] for c in of_table] for i in range(len(part))])

    placed = df.select("id", "features").mapInPandas(run, T.StructType([df.schema["id"], df.schema["features"], T.StructField("codes", codes)]))
    buckets = F.flatten(F.transform("codes", lambda of_table, t: F.transform(of_table, lambda b: F.struct(t.alias("tab"), b.alias("bucket")))))
    return stage(placed.select("id", "features", buckets.alias("buckets")), "hashed")


def knn_join_hashed(
    queries: DataFrame,
    data: DataFrame,
    k: int,
    key: str = "key",
    features: str = "features",
    exclude_self: bool = False,
    tables: int = 6,
    probes: int = 8,
    bucket_rows: int = 256,
    sample_rows: int = 4096,
    block_rows: int = BLOCK_ROWS,
    seed: int = 42,
) -> DataFrame:
    """``(query_id, neighbor_id, distance, rank)``: nearly always the ``k`` nearest points, by hashed buckets.

    A table cuts space by random planes through the medians of at most ``sample_rows`` points, in as many bits as leave
    about ``bucket_rows`` points per bucket.  A point lies in one bucket per table; a query looks into its own and into the ``probes`` buckets across the
    nearest planes.  Distances are exact and ordered by (distance, neighbor id).  More ``tables`` and ``probes`` raise recall
    and cost; a query that meets fewer than ``k`` points is answered by ``knn_join``.  Of equal points only the ``k`` (+ 1) smallest ids
    can be an answer, so copies do not fill a bucket.
    """
    def prepared(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.col(features).cast("array<double>").alias("features"))

    base = stage(prepared(data), "points")
    asked = base if queries is data else stage(prepared(queries), "asked")
    n_data = _checked(base)
    if asked is not base:
        _checked(asked)
    n_bits = min(40, max(1, int(np.ceil(np.log2(max(n_data, 2) / bucket_rows)))))
    sample = base.orderBy(hash_hex(seed, "id"), "id").select("features").limit(sample_rows).collect()
    if not sample:
        return knn_join(queries, data, k, key, features, exclude_self=exclude_self)
    points = np.array([row.features for row in sample], dtype=float)
    planes = np.random.default_rng(seed).normal(size=(tables, n_bits, points.shape[1]))
    cuts = np.median(points @ planes.transpose(0, 2, 1), axis=1)
    need = k + 1 if exclude_self else k
    id_type = base.schema["id"].dataType
    points = _hashed(first_rows(base, ["features"], ["id"], need), planes, cuts, 0)
    asking = _hashed(asked, planes, cuts, probes)
    # a bucket's queries in blocks of about ``block_rows``, each of which meets all points of the bucket
    sizes = asking.select(F.inline("buckets")).groupBy("tab", "bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_blocks"))
    sizes = stage(sizes, "sizes")
    own = F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))

    def placed(df: DataFrame, block: Column, turn: int) -> DataFrame:
        rows = df.select(F.col("id").cast(id_type).alias("id"), "features", F.inline("buckets")).join(sizes, ["tab", "bucket"])
        return rows.select("tab", "bucket", block.alias("block"), F.lit(turn).alias("turn"), F.lit(0).alias("cell"), "id", "features")

    schema = T.StructType(
        [T.StructField("query_id", id_type), T.StructField("neighbor_id", id_type), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    )
    keys = ["tab", "bucket", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _met(batches, keys, k, 2, exclude_self)

    dealt = placed(asking, own, 0).unionByName(placed(points, every, 1)).repartition(*keys).sortWithinPartitions(*keys, "turn")
    found = dealt.mapInArrow(run, schema).select(F.col("query_id").cast(asked.schema["id"].dataType).alias("query_id"), "neighbor_id", "distance")
    # the same neighbour may come from several tables, at the same distance; all steps use one shuffle by query, and most rows go by sorting
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    met = found.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place").dropDuplicates(["query_id", "neighbor_id"])
    near = stage(first_rows(met, ["query_id"], ["distance", "neighbor_id"], k, rank_column="rank"), "near")
    full = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = stage(asked.join(full, "id", "left_anti"), "short")
    if short.isEmpty():
        return near
    rest = knn_join(short, base, k, "id", "features", exclude_self=exclude_self, block_rows=block_rows)
    return near.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(rest)


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    k: int = 5,
    key: str = "key",
    features: str = "features",
    label: str = "label",
    n_classes: int = 2,
    weights: str = "uniform",
    p: int = 2,
) -> DataFrame:
    """Nearest-neighbour votes as ``(key, y_pred, proba)``.

    With ``weights='distance'`` votes count 1 / distance; exact matches, where present, decide alone.
    """
    near = knn_join(test, train, k, key, features, p)
    labels = train.select(F.col(key).alias("neighbor_id"), F.col(label).alias("vote"))
    voted = near.join(labels, "neighbor_id")
    exact = F.col("distance") == 0
    per_query = voted.groupBy("query_id").agg(
        *[
            F.struct(
                F.count_if(F.col("vote") == c).alias("n"),
                F.count_if(exact & (F.col("vote") == c)).alias("exact"),
                F.sum(F.when(F.col("vote") == c, F.try_divide(F.lit(1.0), F.col("distance")))).alias("inverse"),
            ).alias(f"c{c}")
            for c in range(n_classes)
        ]
    )
    names = [f"c{c}" for c in range(n_classes)]
    if weights == "uniform":
        votes = F.array(*[F.col(f"{n}.n").cast("double") for n in names])
    else:
        any_exact = sum((F.col(f"{n}.exact") for n in names), F.lit(0)) > 0
        votes = F.array(
            *[
                F.when(any_exact, F.col(f"{n}.exact").cast("double")).otherwise(
                    F.coalesce(F.col(f"{n}.inverse"), F.lit(0.0))
                )
                for n in names
            ]
        )
    total = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x)
    scored = per_query.select(F.col("query_id").alias(key), votes.alias("votes")).select(
        key, F.transform("votes", lambda v: v / total).alias("proba")
    )
    best = F.array_position("proba", F.array_max("proba")) - 1
    return scored.select(key, best.cast("int").alias("y_pred"), "proba")
