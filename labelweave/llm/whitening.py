"""Whitening of vectors by shifted CholeskyQR.

Rows are quantised to integers and the fit list, each distinct row once, is centred exactly.  Each pass sums the Gram matrix of the rows
as orthogonalised so far; its Cholesky factor orthogonalises them further by a triangular solve, and the factors are composed.  The singular
value decomposition of the composed factor gives the components, so no squared condition number enters them.  Only sums of ``d * d``
numbers per task cross the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.runtime import stage

SCALE, OFFSET = 64.0, 1_000_000
#: Quantised values end here, so that sums and differences stay whole numbers of 64 bits.
LARGEST = 1 << 60
MOST_COMPONENTS = 16
#: Passes after which a Gram matrix that is still not the identity is taken as that of dependent dimensions.
MOST_PASSES = 6
#: The largest distance from the identity at which rows count as orthonormal.
ORTHONORMAL = 1e-13
#: Rows worked on at a time.
ROWS = 2048

_UNIT = np.finfo(float).eps / 2


def quantise(rows: np.ndarray) -> np.ndarray:
    """``floor(64 c) + 1000000`` as 64-bit integers, kept within ``LARGEST``."""
    return np.clip(np.floor(rows.astype(float) * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n * x - S`` exactly: 64-bit integers, or Python's where they would not hold them."""
    bound = n * int(np.abs(x).max(initial=0)) + max((abs(t) for t in total), default=0)
    if bound < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``x - S / n``, rounded once."""
    return (deviations(x, n, total) / n).astype(float)


def right_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows @ inv(r)`` for an upper triangular ``r``, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


@dataclass(frozen=True)
class Whitening:
    """Whitening of vectors of one length: sums of the fit list, components (columns) and their eigenvalues."""

    n: int
    total: list[int]
    components: np.ndarray
    variance: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.variance > 0, np.sqrt(np.maximum(self.variance, 1e-300)), np.inf)
        return centred(x, self.n, self.total) @ self.components / scale


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrices of the vectors of each length, ``ROWS`` rows at most."""
    for at in range(0, batch.num_rows, ROWS):
        lists = batch.column(column).slice(at, ROWS)
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            yield rows + at, flat[(ends[rows] - d)[:, None] + np.arange(d)]


def _sums(rows: DataFrame, name: str, column: str, function: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Sum over all rows of a matrix that ``function`` makes of those of one vector length.

    Each task hands over one matrix per length, by rows; Spark adds them by (length, row, position).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch, column):
                part = function(x)
                d = x.shape[1]
                held[d] = held[d] + part if d in held else part
        for d, part in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), d, np.int32)), pa.array(np.arange(len(part), dtype=np.int32)), pa.array(list(part), pa.list_(pa.float64()))],
                names=["d", "i", "row"],
            )

    parts = rows.select(column).mapInArrow(run, "d int, i int, row array<double>")
    added = parts.select("d", "i", F.posexplode("row").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    table = stage(added, name).toArrow()
    columns = [table.column(c).to_numpy() for c in ("d", "i", "j", "v")]
    out = {}
    for d in np.unique(columns[0]).tolist():
        i, j, v = (c[columns[0] == d] for c in columns[1:])
        out[d] = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
        out[d][i, j] = v
    return out


def fit_whitening(fit: DataFrame, count: int = MOST_COMPONENTS, column: str = "x") -> dict[int, Whitening]:
    """A whitening for each vector length of the fit list ``x ARRAY<BIGINT>``.

    The driver holds a few ``d * d`` matrices per vector length, whatever the number of rows.
    """
    size = F.size(column)
    one = fit.select(size.alias("d"), F.posexplode(column).alias("j", "v"))
    sums = stage(one.groupBy("d", "j").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")), "whitening_sums").toArrow().to_pylist()
    n = {r["d"]: r["n"] for r in sums}
    total: dict[int, list[int]] = {d: [0] * d for d in n}
    for r in sums:
        total[r["d"]][r["j"]] = int(r["s"])
    factors: dict[int, list[np.ndarray]] = {d: [] for d in n}

    def rows_of(x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        out = centred(x, n[d], total[d])
        for r in factors[d]:
            out = right_solve(out, r)
        return out

    def gram(x: np.ndarray) -> np.ndarray:
        q = rows_of(x)
        return q.T @ q

    last: dict[int, np.ndarray] = {}
    open_lengths = set(n)
    for turn in range(MOST_PASSES):
        todo = fit if len(open_lengths) == len(n) else fit.filter(size.isin(*open_lengths))
        last |= _sums(todo, "gram", column, gram)
        for d in sorted(open_lengths):
            g = last[d]
            if np.abs(g - np.eye(d)).max() <= ORTHONORMAL * d or turn == MOST_PASSES - 1 or not g.any():
                open_lengths.discard(d)
                continue
            # the shift bounds the rounding of the Gram matrix, so that the factorisation cannot break down
            shift = 11 * (n[d] * d + d * (d + 1)) * _UNIT if turn == 0 else 4 * d * (d + 1) * _UNIT
            factors[d] = [*factors[d], np.linalg.cholesky(g + shift * np.linalg.norm(g, 2) * np.eye(d)).T]
        if not open_lengths:
            break
    out = {}
    for d in n:
        r = np.eye(d)
        for factor in factors[d]:
            r = factor @ r
        # what is left of the Gram matrix after the last pass: the identity, but for dependent dimensions
        value, vector = np.linalg.eigh(last[d])
        _, s, vt = np.linalg.svd((np.sqrt(np.maximum(value, 0))[:, None] * vector.T) @ r / np.sqrt(n[d]))
        e = s**2
        e[s <= s[0] * d * 2 * _UNIT] = 0.0
        k = min(count, d)
        whole = e.sum()
        out[d] = Whitening(n[d], total[d], vt[:k].T, e[:k], e[:k] / whole if whole > 0 else np.zeros(k))
    return out


def identity_errors(fit: DataFrame, models: dict[int, Whitening], column: str = "x") -> dict[int, float]:
    """Largest entry of the whitened fit list's covariance minus the identity, measured in a pass of its own."""

    def moments(x: np.ndarray) -> np.ndarray:
        z = models[x.shape[1]].whiten(x)
        return np.vstack([z.T @ z, z.sum(0)])

    out = {}
    for d, sums in _sums(fit, "whitened_gram", column, moments).items():
        m = models[d]
        mean = sums[-1] / m.n
        error = sums[:-1] / m.n - np.outer(mean, mean) - np.diag((m.variance > 0).astype(float))
        out[d] = float(np.abs(error).max())
    return out


def whiten_vectors(vectors: DataFrame, count: int = MOST_COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    Vectors that are null or hold null or non-finite entries are left out, and empty ones have no component.  Vectors of one length are
    fitted together, apart from those of other lengths.  Repeated rows, repeated and null ids keep their own output rows and count once in
    the fit.  Equal eigenvalues are numbered as the decomposition gives them.  A component without variance (dependent or constant
    dimensions, a single distinct vector) whitens to 0 and is no part of the identity error.  ``deviation`` is exact, and null where a long cannot hold
    it; values end at 2**60 when quantised.  Other columns are ignored; an empty table gives no rows.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.filter(e.isNotNull() & finite & (F.size(e) > 0)).select("vec_id", e.cast("array<double>").alias("embedding"))

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, v in _by_length(batch, "embedding"):
                yield pa.RecordBatch.from_arrays([pa.array(list(quantise(v)), pa.list_(pa.int64()))], names=["x"])

    fit = stage(kept.select("embedding").mapInArrow(integers, "x array<bigint>").distinct(), "fit_list")
    models = fit_whitening(fit, count)
    errors = identity_errors(fit, models)
    shared = vectors.sparkSession.sparkContext.broadcast((models, errors))
    schema = vectors.select("vec_id").schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)
    schema += ", component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = shared.value
        for batch in batches:
            for rows, v in _by_length(batch, "embedding"):
                x = quantise(v)
                d = x.shape[1]
                m = models[d]
                k = len(m.variance)
                off = deviations(x, m.n, m.total)
                if off.dtype != object and d * int(np.abs(off).max()) ** 2 >= 1 << 63:
                    off = off.astype(object)
                square = (off * off).sum(1)
                square = [s if s < 1 << 63 else None for s in square.tolist()]
                repeat = np.repeat(np.arange(len(rows)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows[repeat])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(repeat), m.n)),
                        pa.array(square, pa.int64()).take(pa.array(repeat)),
                        pa.array(m.whiten(x).ravel()),
                        pa.array(np.tile(m.explained, len(rows))),
                        pa.array(np.full(len(repeat), errors[d])),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return kept.mapInArrow(run, schema)
