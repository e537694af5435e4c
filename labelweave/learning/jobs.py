"""Fitting many jobs together: the rows of all sets in one table, every job either in one task or by passes over the rows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.learning.kernels import SvmModel, SvmSpec
from labelweave.learning.networks import NetModel, NetSpec, fit_asking_here, fit_by_asking
from labelweave.learning.trees import MOST_BINS, TreeModel, TreeSpec, binned, by_key, coarser, effort, exact_edges, fit_bins, fit_by_levels, fit_here, matrix_of, set_edges
from labelweave.runtime import stage

Spec = TreeSpec | NetSpec | SvmSpec
Model = TreeModel | NetModel | SvmModel

#: Rows times features of a set whose jobs are fitted in one task each.  Boosting and perceptrons, which else pass over the rows for every level of every round
#: or for every mini-batch, take so many times as many: 64 MB of values.
LOCAL_CELLS, TURN_TIMES = 1 << 20, 8
#: Values of a larger set, a byte or two each as bins, from which a task grows trees, and pieces of such work for a core.
BINNED_CELLS, PIECES = 1 << 26, 4
#: Rows of a support vector machine's kernel map that a task holds, 2 kB each.
MAPPED_ROWS = 1 << 18


def _rows(sets: DataFrame) -> DataFrame:
    """``set, row, key, label, train, features``; ``row`` is the first 60 bits of the key's digest."""
    digest = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary"))
    return sets.select(
        F.col("set").cast("int").alias("set"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("row"), F.col("key").cast("string").alias("key"),
        F.col("label").cast("int").alias("label"), F.col("train").cast("boolean").alias("train"), F.col("features").cast("array<double>").alias("features"),
    )


def _dealt(rows: DataFrame, jobs: Mapping[int, tuple[int, Spec]], names: Sequence[str]) -> DataFrame:
    """Rows of small sets, once for each of the set's jobs, a job's rows together and in the order of their keys."""
    of_set: dict[int, list[int]] = {}
    for job, (s, _) in jobs.items():
        of_set.setdefault(s, []).append(job)
    table = rows.sparkSession.createDataFrame([(s, j) for s, js in of_set.items() for j in js], "set int, job int")
    # more tasks than jobs, up to some per core, so that few long jobs meet in one
    n = max(1, min(4 * len(jobs), 16 * rows.sparkSession.sparkContext.defaultParallelism))
    return rows.join(F.broadcast(table), "set").select("job", *names).repartition(n, "job").sortWithinPartitions("job", "row", "key")


def fit_jobs(sets: DataFrame, jobs: Mapping[int, tuple[int, Spec]], local_cells: int = LOCAL_CELLS) -> dict[int, Model]:
    """Fit every job ``{job: (set, spec)}`` on the training rows of its set; the models go to the driver.

    ``sets`` has ``set, key, features, label, train``; every set has rows, and features of one length.
    """
    rows = stage(_rows(sets), "sets")
    here, edges = _measured(rows, jobs, local_cells)
    models = {}
    if here:
        shared = rows.sparkSession.sparkContext.broadcast((here, edges))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            jobs, edges = shared.value
            for job, table in by_key(batches, "job"):
                model = _fit_table(jobs[job], edges, table)
                yield pa.RecordBatch.from_arrays([pa.array([job], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], names=["job", "model"])

        dealt = _dealt(rows.filter("train"), here, ["row", "key", "label", "features"])
        models = {r.job: pickle.loads(r.model) for r in stage(dealt.mapInArrow(run, "job int, model binary"), "models").toLocalIterator()}
    return models | _fit_away(rows, {j: v for j, v in jobs.items() if j not in here}, edges, local_cells)


def _fit_table(job: tuple[int, Spec], edges: dict, table: pa.Table) -> Model:
    x = matrix_of(table.column("features").combine_chunks())
    label, rows = table.column("label").to_numpy(), table.column("row").to_numpy()
    return fit_here(job[1], x, label, rows, edges[job[0]]) if isinstance(job[1], TreeSpec) else fit_asking_here(job[1], x, label, rows)


def _fit_away(rows: DataFrame, jobs: Mapping[int, tuple[int, Spec]], edges: dict, local_cells: int) -> dict[int, Model]:
    """Jobs on sets that no task holds."""
    train = rows.filter("train")
    trees = {j: v for j, v in jobs.items() if isinstance(v[1], TreeSpec)}
    return fit_by_levels(train, trees, edges, local_cells) | fit_by_asking(train, {j: v for j, v in jobs.items() if j not in trees})


def _cells(rows: DataFrame) -> dict[int, int]:
    sizes = rows.groupBy("set").agg((F.count("*") * F.max(F.size("features"))).alias("cells")).collect()
    return {r.set: r.cells for r in sizes}


def _bins(jobs: Mapping[int, tuple[int, Spec]]) -> dict[int, int]:
    bins: dict[int, int] = {}
    for s, spec in jobs.values():
        if isinstance(spec, TreeSpec):
            bins[s] = max(bins.get(s, 2), min(spec.bins, MOST_BINS))
    return bins


def _measured(rows: DataFrame, jobs: Mapping[int, tuple[int, Spec]], local_cells: int) -> tuple[dict[int, tuple[int, Spec]], dict[int, list[np.ndarray]]]:
    """The jobs whose sets a task can hold, and the edges of all sets."""
    cells = _cells(rows)
    by_turns = lambda spec: isinstance(spec, NetSpec) or isinstance(spec, TreeSpec) and spec.kind == "boost"
    most = lambda spec: local_cells * (TURN_TIMES if by_turns(spec) else 1)
    here = {j: v for j, v in jobs.items() if v[0] in cells and cells[v[0]] <= most(v[1])}
    return here, set_edges(rows, _bins(jobs))


def _also_here(rows: DataFrame, jobs: Mapping[int, tuple[int, Spec]]) -> dict[int, tuple[int, Spec]]:
    """Support vector machines whose mapped rows a task can hold: passes over the rows take many times as long."""
    machines = {j: v for j, v in jobs.items() if isinstance(v[1], SvmSpec)}
    if not machines:
        return {}
    counts = {r.set: r["count"] for r in rows.groupBy("set").count().collect()}
    return {j: v for j, v in machines.items() if counts.get(v[0], 0) <= MAPPED_ROWS}


def _near(rows: DataFrame, jobs: Mapping[int, tuple[int, Spec]], local_cells: int, binned_cells: int) -> list[tuple[int, dict[int, tuple[int, Spec]]]]:
    """Tree jobs whose sets a task can hold as bins alone, in pieces ``(set, jobs)`` of like effort, the longest first."""
    if binned_cells <= local_cells or not any(isinstance(spec, TreeSpec) for _, spec in jobs.values()):
        return []
    facts = {r.set: r for r in rows.groupBy("set").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).collect()}
    taken = {j: v for j, v in jobs.items() if isinstance(v[1], TreeSpec) and v[0] in facts and local_cells < facts[v[0]].n * facts[v[0]].d <= binned_cells}
    if not taken:
        return []
    cost = {j: facts[s].n * effort(spec, facts[s].d) for j, (s, spec) in taken.items()}
    most = max(max(cost.values()), sum(cost.values()) / (PIECES * rows.sparkSession.sparkContext.defaultParallelism))
    pieces: list[list] = []
    for job in sorted(taken, key=lambda j: (-cost[j], j)):
        fitting = [p for p in pieces if p[1] == taken[job][0] and p[0] + cost[job] <= most]
        if fitting:
            fitting[0][0] += cost[job]
            fitting[0][2][job] = taken[job]
        else:
            pieces.append([cost[job], taken[job][0], {job: taken[job]}])
    return [(s, held) for _, s, held in sorted(pieces, key=lambda p: -p[0])]


def _predict_near(rows: DataFrame, pieces: list[tuple[int, dict[int, tuple[int, Spec]]]], score_train: bool) -> DataFrame:
    """Predictions of the jobs of every piece: rows are binned before they are dealt, so that a task holds a byte or two of each value."""
    edges = exact_edges(rows, _bins({j: v for _, held in pieces for j, v in held.items()}))
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(([held for _, held in pieces], edges))

    def kind_of(edges: list[np.ndarray]) -> type:
        return np.uint8 if max(len(e) for e in edges) < 256 else np.uint16

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value[1]
        for batch in batches:
            sets = batch.column("set").to_numpy()
            for s in np.unique(sets).tolist():
                part = batch.take(pa.array(np.flatnonzero(sets == s)))
                values = binned(matrix_of(part.column("features")), edges[s], kind_of(edges[s])).view(np.uint8).reshape(part.num_rows, -1)
                ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
                held = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("set", "row", "key", "label", "train")), held], names=["set", "row", "key", "label", "train", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, edges = shared.value
        for piece, table in by_key(batches, "piece"):
            jobs = pieces[piece]
            own = edges[next(iter(jobs.values()))[0]]
            held = table.column("held").combine_chunks()
            start, end = held.offset, held.offset + len(held)
            at = np.frombuffer(held.buffers()[1], np.int32)[[start, end]]
            cells = np.frombuffer(held.buffers()[2], np.uint8)[at[0] : at[1]].view(kind_of(own)).reshape(len(held), -1)
            train, label, row = (table.column(c).to_numpy() for c in ("train", "label", "row"))
            scored = table if score_train else table.filter(pa.array(~train))
            for job, (_, spec) in jobs.items():
                x = coarser(cells, own, spec.bins)
                model = fit_bins(spec, x[train], label[train], row[train])
                if scored.num_rows:
                    yield from _in_parts(_predicted(job, scored, model.proba(x if score_train else x[~train])))

    small = rows.mapInArrow(shrink, "set int, row bigint, key string, label int, train boolean, held binary")
    of_set = rows.sparkSession.createDataFrame([(s, i) for i, (s, _) in enumerate(pieces)], "set int, piece int")
    dealt = small.join(F.broadcast(of_set), "set").select("piece", "row", "key", "label", "train", "held")
    return dealt.repartitionById(len(pieces), F.col("piece")).sortWithinPartitions("piece", "row", "key").mapInArrow(run, PREDICTED)


def _in_parts(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


PREDICTED = "job int, key string, y_true int, y_pred int, proba array<double>, train boolean"


def _predicted(job: int, table: pa.Table, p: np.ndarray) -> pa.RecordBatch:
    n = len(p)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, job, np.int32)), table.column("key").combine_chunks(), table.column("label").combine_chunks(),
            pa.array(p.argmax(1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel())), table.column("train").combine_chunks(),
        ],
        names=["job", "key", "y_true", "y_pred", "proba", "train"],
    )


def fit_predict(sets: DataFrame, jobs: Mapping[int, tuple[int, Spec]], score_train: bool = False, local_cells: int = LOCAL_CELLS, binned_cells: int = 0) -> DataFrame:
    """Predictions of every job for the other rows of its set (and its training rows): ``job, key, y_true, y_pred, proba, train``.

    ``sets`` as for :func:`fit_jobs`.  Jobs of small sets are fitted and scored in one task, so no model leaves it; so are trees on larger sets of up to
    ``binned_cells`` feature values, from the rows' bins.
    """
    rows = stage(_rows(sets), "sets")
    pieces = _near(rows, jobs, local_cells, binned_cells)
    near = {j for _, held in pieces for j in held}
    jobs = {j: v for j, v in jobs.items() if j not in near}
    here, edges = _measured(rows, jobs, local_cells) if jobs else ({}, {})
    if binned_cells:
        here |= _also_here(rows, jobs)
    away = {j: v for j, v in jobs.items() if j not in here}
    context = rows.sparkSession.sparkContext
    parts = [_predict_near(rows, pieces, score_train)] if pieces else []
    if here:
        shared = context.broadcast((here, edges))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            jobs, edges = shared.value
            for job, table in by_key(batches, "job"):
                train = table.column("train").to_numpy()
                model = _fit_table(jobs[job], edges, table.filter(pa.array(train)))
                scored = table if score_train else table.filter(pa.array(~train))
                if scored.num_rows:
                    yield _predicted(job, scored, model.proba(matrix_of(scored.column("features").combine_chunks())))

        parts.append(_dealt(rows, here, ["row", "key", "label", "train", "features"]).mapInArrow(run, PREDICTED))
    if away:
        held = context.broadcast(({j: away[j][0] for j in away}, _fit_away(rows, away, edges, local_cells)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of_job, models = held.value
            for batch in batches:
                table = pa.Table.from_batches([batch])
                sets = batch.column("set").to_numpy()
                for job, s in of_job.items():
                    part = table.filter(pa.array(sets == s))
                    if part.num_rows:
                        yield _predicted(job, part, models[job].proba(matrix_of(part.column("features").combine_chunks())))

        wanted = rows if score_train else rows.filter("NOT train")
        parts.append(wanted.mapInArrow(score, PREDICTED))
    return stage(reduce(DataFrame.unionByName, parts), "predictions")
