"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's evidence is its own features and those of its neighbours; transitions
tie adjacent lines together.  The forward-backward marginals, weighted by line length, give the document's quality.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import fold, labelled_sample, map_texts

#: Documents of each class that are used for fitting, at most.
SAMPLE_PER_CLASS = 2000
STEPS, RATE, DECAY = 150, 0.15, 1e-3
#: Byte classes: lower, upper, digit, space, sentence mark, symbol, other bytes (letters beyond ASCII)
_CLASS = np.full(256, 6, np.uint8)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = (
        0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:'\"-()?" else 5
    )
N_CLASSES = 7
#: own features of a line: bias, class shares, words, mean word length, repeated words, repeated line, marks after words
N_OWN = 1 + N_CLASSES + 5
N_ALL = 1 + 3 * (N_OWN - 1)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, the lines' lengths in bytes, and each text's number of lines."""
    lines: list[bytes] = []
    counts, extra = [], []
    for text in texts:
        own = text.encode("utf-8", "surrogatepass").split(b"\n")
        counts.append(len(own))
        seen: set[bytes] = set()
        for line in own:
            words = line.split()
            n = len(words)
            extra.append((np.log1p(n), (len(line) / n if n else 0.0) / 10, 1 - len(set(words)) / n if n else 0.0, line in seen and n > 0))
            seen.add(line)
        lines += own
    joined = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    sizes = np.array([len(x) for x in lines], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    kinds = _CLASS[joined]
    x = np.zeros((len(lines), N_OWN))
    x[:, 0] = 1
    total = np.maximum(sizes, 1)
    for c in range(N_CLASSES):
        x[:, 1 + c] = (np.add.reduceat((kinds == c).view(np.uint8), starts, dtype=np.int64) - (c == 3)) / total
    x[:, 1 + N_CLASSES : 5 + N_CLASSES] = np.array(extra, float)
    marks = np.zeros(len(kinds), np.uint8)
    marks[:-1] = (kinds[:-1] == 5) & (kinds[1:] == 3)
    x[:, 5 + N_CLASSES] = np.add.reduceat(marks, starts, dtype=np.int64) / np.maximum(np.expm1(x[:, 1 + N_CLASSES]), 1)
    return x, sizes, np.array(counts, np.int64)


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, then the previous and the next line's (zero beyond a document's ends)."""
    before, after = np.zeros((len(x), N_OWN - 1)), np.zeros((len(x), N_OWN - 1))
    before[1:], after[:-1] = x[:-1, 1:], x[1:, 1:]
    ends = np.cumsum(counts)
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.hstack([x, before, after])


def marginals(unary: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once.

    ``unary`` has a log potential per line for bad and good, ``trans[from, to]`` ties neighbours.  Returns each
    line's marginals and the expected number of each transition.  Documents are taken in the order of their
    length, so step ``t`` works on those that have a line ``t``.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    left = counts[order]
    e = np.exp(unary - unary.max(1, keepdims=True))
    m = np.exp(trans)
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    longest = int(left[0]) if len(left) else 0
    active = [int(np.searchsorted(-left, -t, side="left")) for t in range(longest + 1)]  # documents longer than t
    for t in range(longest):
        at = starts[: active[t]] + t
        now = e[at] if t == 0 else e[at] * (alpha[at - 1] @ m)
        alpha[at] = now / now.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        tail = e[at + 1] * beta[at + 1]
        back = tail @ m.T
        beta[at] = back / back.sum(1, keepdims=True)
        pair = alpha[at][:, :, None] * m[None] * tail[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    p = alpha * beta
    return p / p.sum(1, keepdims=True), expected


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # features x (bad, good)
    trans: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float]


def _document_quality(x, sizes, counts, model: QualityModel) -> np.ndarray:
    unary = ((with_neighbours(x, counts) - model.mean) / model.scale) @ model.weights
    p, _ = marginals(unary, model.trans, counts)
    starts = np.cumsum(counts) - counts
    weight = sizes + 1.0
    good = np.add.reduceat(p[:, 1] * weight, starts) / np.add.reduceat(weight, starts)
    return np.clip(good, 1e-6, 1 - 1e-6)


def fit_quality(sample: list[tuple[str, int]]) -> QualityModel:
    """Maximum likelihood of the line labels, every line having its document's label, then a logistic curve from
    the aggregated marginal to the document's label.  Without rows of both classes the score is constant."""
    n_good = sum(y for _, y in sample)
    base = (n_good + 0.5) / (len(sample) + 1.0)
    model = QualityModel(np.zeros((N_ALL, 2)), np.zeros((2, 2)), np.zeros(N_ALL), np.ones(N_ALL), (float(np.log(base / (1 - base))), 0.0))
    if n_good in (0, len(sample)):
        return model
    x, sizes, counts = line_features([t for t, _ in sample])
    full = with_neighbours(x, counts)
    mean, scale = full.mean(0), full.std(0)
    mean[0], scale[0] = 0.0, 1.0
    scale[scale < 1e-9] = 1.0
    z = (full - mean) / scale
    label = np.array([y for _, y in sample])
    lines = np.repeat(label, counts)
    # a document counts as one example of its class, however many lines it has
    per_doc = np.where(label == 1, 0.5 / n_good, 0.5 / (len(sample) - n_good)) / counts
    weight = np.repeat(per_doc, counts)
    truth = np.stack([1 - lines, lines], 1)
    same = np.zeros((2, 2))
    for y in (0, 1):
        same[y, y] = (per_doc * (counts - 1))[label == y].sum()
    theta, trans = np.zeros((N_ALL, 2)), np.zeros((2, 2))
    speed = [np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(trans), np.zeros_like(trans)]
    groups = [(label == y) for y in (0, 1)]
    for step in range(1, STEPS + 1):
        unary = z @ theta
        p, _ = marginals(unary, trans, counts)
        g = z.T @ (weight[:, None] * (truth - p)) - DECAY * theta
        # expected transitions weighed like the lines: one pass per class and average length
        h = same.copy()
        for y, rows in enumerate(groups):
            inside = np.repeat(rows, counts)
            _, expected = marginals(unary[inside], trans, counts[rows])
            h -= expected * (same[y, y] / max(expected.sum(), 1e-9))
        h -= DECAY * trans
        for k, (value, grad) in enumerate(((theta, g), (trans, h))):
            speed[2 * k] = 0.9 * speed[2 * k] + 0.1 * grad
            speed[2 * k + 1] = 0.99 * speed[2 * k + 1] + 0.01 * grad**2
            value += RATE * (speed[2 * k] / (1 - 0.9**step)) / (np.sqrt(speed[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    model = QualityModel(theta, trans, mean, scale, (0.0, 1.0))
    quality = _document_quality(x, sizes, counts, model)
    u = np.log(quality / (1 - quality))
    a = np.stack([np.ones_like(u), u], 1)
    w = np.array([0.0, 0.1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (q * (1 - q))[:, None]).T @ a + np.diag([1e-3, 1e-2])
        w += np.linalg.solve(hess, a.T @ (label - q) - np.array([1e-3, 1e-2]) * w)
    # the sample takes the classes in equal numbers at most; the even point stays the sample's
    return QualityModel(theta, trans, mean, scale, (float(w[0]), float(w[1])))


def score_texts(texts: list[str], model: QualityModel) -> list[float]:
    if not texts:
        return []
    u = _document_quality(*line_features(texts), model)
    a, b = model.curve
    return [float(v) for v in 1 / (1 + np.exp(-np.clip(a + b * np.log(u / (1 - u)), -30, 30)))]


def learn_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Fit on at most ``2 * per_class`` labelled documents outside the held-out fold."""
    rows = labelled_sample(docs, labels, "quality", per_class).select("doc_id", "text", "label").collect()
    rows = sorted((r.doc_id, r.text or "", int(r.label)) for r in rows)
    return fit_quality([(t, y) for _, t, y in rows])


def score_quality(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``score`` for every document.

    A null or empty text is one empty line.  Rows are independent, so repeated ids keep a row each; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: lambda texts: {"score": score_texts(texts, shared.value)}, "score double", keep)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    scored = score_quality(docs, learn_quality(docs, labels))
    return scored.select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
