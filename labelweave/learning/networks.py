"""Multi-layer perceptrons, and the fitting by questions, for many jobs at once: tanh, relu or logistic layers, L2, and adam, sgd or L-BFGS.

An optimiser is a generator that asks for the loss and gradient at its weights, on all rows or on one mini-batch.  Rows are dealt to mini-batches
by a hash of (seed, epoch, row).  For a set that a task can hold the answers come from memory; for a larger one the questions of all jobs are answered
together by one pass over the rows, in which each task sums the gradients of its own rows; one row per job and task goes to the driver, which adds them up.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.learning.trees import by_key, draws, link, matrix_of
from labelweave.runtime import stage

#: Rows of a mini-batch, and mini-batches of an epoch at most: a large set has larger ones.
BATCH_ROWS, MOST_STEPS = 200, 32
#: Epochs without an improvement of ``tol`` that end the training, or lower an adaptive rate.
PATIENCE = 10
MOMENTUM, POWER, MEMORY = 0.9, 0.5, 10


@dataclass(frozen=True)
class NetSpec:
    """A network and how it is trained."""

    n_classes: int = 2
    hidden: tuple[int, ...] = (100,)
    activation: str = "relu"
    alpha: float = 1e-4
    solver: str = "adam"
    rate: float = 1e-3
    schedule: str = "constant"
    epochs: int = 200
    tol: float = 1e-4
    seed: int = 42

    @property
    def outputs(self) -> int:
        return 1 if self.n_classes == 2 else self.n_classes

    def aid(self, landmarks: np.ndarray, varying: int) -> None:
        """Networks need none."""

    def training(self, width: int, n: int, counts: np.ndarray, aid: None) -> Generator:
        return optimise(self, width, n)

    def kept(self, z: np.ndarray, label: np.ndarray, rows: np.ndarray, aid: None) -> dict:
        """What the questions are answered from; the mini-batches of an epoch are dealt once."""
        return {"z": z, "label": label, "rows": rows, "epoch": None, "batches": []}

    def answer(self, question: Question, kept: dict) -> tuple[float, np.ndarray, int]:
        w, epoch, number, steps = question
        z, label = kept["z"], kept["label"]
        if steps:
            if kept["epoch"] != (epoch, steps):
                batch = batches_of(self, epoch, steps, kept["rows"])
                order = np.argsort(batch, kind="stable")
                kept["epoch"], kept["batches"] = (epoch, steps), np.split(order, np.searchsorted(batch[order], np.arange(1, steps)))
            use = kept["batches"][number]
            z, label = z[use], label[use]
        return (*loss_sums(self, w, z, label), len(z))

    def model(self, mean: np.ndarray, spread: np.ndarray, final: np.ndarray, aid: None) -> NetModel:
        return NetModel(self, mean, spread, final)

    def shapes(self, width: int) -> list[tuple[int, int]]:
        sizes = [width, *self.hidden, self.outputs]
        return list(zip(sizes[:-1], sizes[1:]))


Question = tuple[np.ndarray, int, int, int]  # weights, epoch, mini-batch, mini-batches; 0 mini-batches: all rows


def first_weights(spec: NetSpec, width: int) -> np.ndarray:
    """Uniform weights within a bound of the layer's inputs and outputs, flat, each layer's biases behind its weights."""
    parts = []
    for k, (a, b) in enumerate(spec.shapes(width)):
        bound = math.sqrt((2.0 if spec.activation == "logistic" else 6.0) / (a + b))
        parts.append((2 * draws(spec.seed, 8, k, np.arange(a * b + b)) - 1) * bound)
    return np.concatenate(parts)


def _layers(spec: NetSpec, w: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in spec.shapes(width):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _active(spec: NetSpec, z: np.ndarray) -> np.ndarray:
    if spec.activation == "tanh":
        return np.tanh(z)
    if spec.activation == "relu":
        return np.maximum(z, 0)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _slope(spec: NetSpec, h: np.ndarray) -> np.ndarray:
    """The activation's derivative from its value."""
    if spec.activation == "tanh":
        return 1 - h * h
    if spec.activation == "relu":
        return (h > 0).astype(float)
    return h * (1 - h)


def margins(spec: NetSpec, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = x
    layers = _layers(spec, w, x.shape[1])
    for weight, bias in layers[:-1]:
        h = _active(spec, h @ weight + bias)
    return h @ layers[-1][0] + layers[-1][1]


def loss_sums(spec: NetSpec, w: np.ndarray, x: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the rows' cross-entropies and of its gradients, without the L2 term."""
    layers = _layers(spec, w, x.shape[1])
    held = [x]
    for weight, bias in layers[:-1]:
        held.append(_active(spec, held[-1] @ weight + bias))
    p = link(held[-1] @ layers[-1][0] + layers[-1][1])
    loss = -np.log(np.maximum(p[np.arange(len(x)), label], 1e-300)).sum()
    delta = p.copy()
    delta[np.arange(len(x)), label] -= 1
    if spec.outputs == 1:
        delta = delta[:, 1:]
    parts = []
    for k in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(held[k].T @ delta).ravel(), delta.sum(0)]))
        if k:
            delta = (delta @ layers[k][0].T) * _slope(spec, held[k])
    return float(loss), np.concatenate(parts[::-1])


def _penalty(spec: NetSpec, w: np.ndarray, width: int) -> np.ndarray:
    """The weights without the biases, which are not shrunken."""
    out, at = w.copy(), 0
    for a, b in spec.shapes(width):
        out[at + a * b : at + a * b + b] = 0
        at += a * b + b
    return out


def optimise(spec: NetSpec, width: int, n: int) -> Generator[Question, tuple[float, np.ndarray, int], np.ndarray]:
    """Ask for sums over rows ``(loss, gradient, rows)`` and return the final weights."""
    w = first_weights(spec, width)

    def mean(w, answer):
        loss, gradient, rows = answer
        shrunk = _penalty(spec, w, width)
        rows = max(rows, 1)
        return (loss + 0.5 * spec.alpha * float(shrunk @ shrunk)) / rows, (gradient + spec.alpha * shrunk) / rows

    if spec.solver == "lbfgs":
        return (yield from minimise(spec.epochs, spec.tol, w, mean, (0, 0, 0)))
    steps = max(1, min(MOST_STEPS, -(-n // BATCH_ROWS)))
    rate, best, stalled, t = spec.rate, math.inf, 0, 0
    first, second = np.zeros_like(w), np.zeros_like(w)
    for epoch in range(spec.epochs):
        total = rows = 0.0
        for batch in range(steps):
            answer = yield w, epoch, batch, steps
            if not answer[2]:
                continue
            loss, gradient = mean(w, answer)
            total, rows, t = total + loss * answer[2], rows + answer[2], t + 1
            if spec.solver == "sgd":
                # Nesterov's momentum
                first = MOMENTUM * first - rate * gradient
                w = w + MOMENTUM * first - rate * gradient
            else:
                first = 0.9 * first + 0.1 * gradient
                second = 0.999 * second + 0.001 * gradient**2
                w = w - rate * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * first / (np.sqrt(second) + 1e-8)
        loss = total / max(rows, 1)
        if spec.solver == "sgd" and spec.schedule == "invscaling":
            rate = spec.rate / (1 + (epoch + 1) * n) ** POWER
        stalled = stalled + 1 if loss > best - spec.tol else 0
        best = min(best, loss)
        if stalled > PATIENCE:
            if spec.solver != "sgd" or spec.schedule != "adaptive" or rate <= 1e-6:
                break
            rate, stalled = rate / 5, 0
    return w


def minimise(turns: int, tol: float, w: np.ndarray, mean, asked: tuple) -> Generator[tuple, tuple[float, np.ndarray, int], np.ndarray]:
    """L-BFGS with a backtracking line search: asks ``(weights, *asked)``; ``mean`` makes loss and gradient of an answer."""
    loss, gradient = mean(w, (yield w, *asked))
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(turns):
        if np.abs(gradient).max() <= tol:
            break
        step = gradient.copy()
        back = []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ step)
            back.append(a)
            step -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            step *= (s @ y) / (y @ y)
        else:
            step /= max(1.0, float(np.linalg.norm(gradient)))
        for (s, y, rho), a in zip(pairs, reversed(back)):
            step += s * (a - rho * (y @ step))
        slope, size = float(gradient @ step), 1.0
        if slope <= 0:
            step, slope, pairs = gradient, float(gradient @ gradient), []
        for _ in range(25):
            there = w - size * step
            new_loss, new_gradient = mean(there, (yield there, *asked))
            if new_loss <= loss - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = there - w, new_gradient - gradient
        if s @ y > 1e-10 * (y @ y):
            pairs = [*pairs[1 - MEMORY :], (s, y, 1.0 / float(s @ y))]
        done = loss - new_loss <= 1e-9 * max(abs(loss), 1.0)
        w, loss, gradient = there, new_loss, new_gradient
        if done:
            break
    return w


@dataclass
class NetModel:
    spec: NetSpec
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def proba(self, x: np.ndarray) -> np.ndarray:
        return link(margins(self.spec, self.weights, scaled(x, self.mean, self.spread)))


def scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """z-scores; what is missing counts as the mean."""
    return np.nan_to_num((x - mean) / spread, nan=0.0)


def batches_of(spec: NetSpec, epoch: int, steps: int, rows: np.ndarray) -> np.ndarray:
    """The mini-batch of each row in an epoch."""
    return np.zeros(len(rows), int) if not steps else (draws(spec.seed, 7, epoch, rows) * steps).astype(int)


def fit_asking_here(spec, x: np.ndarray, label: np.ndarray, rows: np.ndarray):
    """Fit a network or a support vector machine on training rows held in memory."""
    present = ~np.isnan(x)
    number = np.maximum(present.sum(0), 1)
    mean = np.where(present, x, 0).sum(0) / number
    spread = np.sqrt((np.where(present, x - mean, 0) ** 2).sum(0) / number)
    varying = int((spread > 0).sum())
    spread[spread == 0] = 1.0
    z = scaled(x, mean, spread)
    aid = spec.aid(z[np.argsort(rows, kind="stable")[: getattr(spec, "landmarks", 0)]], varying)
    training = spec.training(z.shape[1], len(z), np.bincount(label, minlength=spec.n_classes), aid)
    kept = spec.kept(z, label, rows, aid)
    answer = None
    try:
        while True:
            answer = spec.answer(training.send(answer), kept)
    except StopIteration as end:
        return spec.model(mean, spread, end.value, aid)


def fit_by_asking(rows: DataFrame, jobs: Mapping) -> dict:
    """Fit jobs on sets of any size (``set, row, label, features``): each pass answers one question of every job."""
    if not jobs:
        return {}
    values = rows.select("set", F.posexplode("features").alias("f", "x")).filter("x IS NOT NULL AND NOT isnan(x)")
    moments = stage(values.groupBy("set", "f").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")), "moments").toArrow().to_pylist()
    sizes = {r.set: (r.n, r.d) for r in rows.groupBy("set").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).collect()}
    counts: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("set", "label").count().collect():
        counts.setdefault(r.set, {})[r.label] = r["count"]
    means = {s: np.zeros(d) for s, (_, d) in sizes.items()}
    spreads = {s: np.zeros(d) for s, (_, d) in sizes.items()}
    for r in moments:
        means[r["set"]][r["f"]], spreads[r["set"]][r["f"]] = r["m"], r["s"]
    varying = {s: int((v > 0).sum()) for s, v in spreads.items()}
    for v in spreads.values():
        v[v == 0] = 1.0
    most: dict[int, int] = {}
    for s, spec in jobs.values():
        most[s] = max(most.get(s, 0), getattr(spec, "landmarks", 0))
    marks = {}
    for s, n in most.items():
        # the digests' order is as good as a draw; so many rows at most come to the driver
        few = rows.filter(F.col("set") == s).select("row", "features").orderBy("row").limit(n).collect() if n else []
        marks[s] = scaled(np.array([r.features for r in few], float).reshape(len(few), len(means[s])), means[s], spreads[s])
    aids = {j: spec.aid(marks[s][: getattr(spec, "landmarks", 0)], varying[s]) for j, (s, spec) in jobs.items()}
    # a file for each core, so that a pass keeps all of them busy
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = stage(rows.filter(F.col("set").isin(sorted(most))).select("set", "row", "label", "features").repartition(cores), "asked")
    told = {j: np.array([counts[s].get(c, 0) for c in range(spec.n_classes)]) for j, (s, spec) in jobs.items()}
    training = {j: spec.training(sizes[s][1], sizes[s][0], told[j], aids[j]) for j, (s, spec) in jobs.items()}
    questions = {j: next(t) for j, t in training.items()}
    models = {}
    while questions:
        answers = _answers(rows, jobs, questions, means, spreads, aids)
        for j in list(questions):
            asked = questions.pop(j)
            try:
                questions[j] = training[j].send(answers.get(j, (0.0, np.zeros_like(asked[0]), 0)))
            except StopIteration as end:
                s, spec = jobs[j]
                models[j] = spec.model(means[s], spreads[s], end.value, aids[j])
    return models


def _answers(rows: DataFrame, jobs, questions: dict[int, tuple], means, spreads, aids) -> dict[int, tuple[float, np.ndarray, int]]:
    shared = rows.sparkSession.sparkContext.broadcast((dict(jobs), questions, means, spreads, aids))
    schema = "job int, n bigint, loss double, gradient array<double>"

    def table(sums: dict[int, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int32()), pa.array([v[2] for v in sums.values()], pa.int64()), pa.array([v[0] for v in sums.values()], pa.float64()),
                pa.array([v[1] for v in sums.values()], pa.list_(pa.float64())),
            ],
            names=["job", "n", "loss", "gradient"],
        )

    def add(sums: dict[int, list], job: int, loss: float, gradient: np.ndarray, n: int) -> None:
        held = sums.get(job)
        sums[job] = [loss, gradient, n] if held is None else [held[0] + loss, held[1] + gradient, held[2] + n]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs, questions, means, spreads, aids = shared.value
        sums: dict[int, list] = {}
        for batch in batches:
            sets, label_of, row_of = (batch.column(c).to_numpy() for c in ("set", "label", "row"))
            for s in np.unique(sets).tolist():
                at = np.flatnonzero(sets == s)
                z = scaled(matrix_of(batch.column("features").take(pa.array(at))), means[s], spreads[s])
                for j, question in questions.items():
                    if jobs[j][0] == s:
                        spec = jobs[j][1]
                        loss, gradient, n = spec.answer(question, spec.kept(z, label_of[at], row_of[at], aids[j]))
                        if n:
                            add(sums, j, loss, gradient, n)
        if sums:
            yield table(sums)

    # one row per task and job, in the order of the tasks
    sums: dict[int, list] = {}
    for r in rows.mapInArrow(own, schema).toArrow().to_batches():
        for job, n, loss, gradient in zip(*(r.column(c) for c in ("job", "n", "loss", "gradient"))):
            add(sums, job.as_py(), loss.as_py(), gradient.values.to_numpy(), n.as_py())
    out = {j: (v[0], np.array(v[1]), v[2]) for j, v in sums.items()}
    shared.unpersist()
    return out
