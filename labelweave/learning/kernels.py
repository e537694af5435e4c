"""Support vector machines on a Nyström map of their kernel, for many jobs at once.

Landmarks are training rows in the order of their keys' digests; the eigenvectors of the landmarks' kernel matrix map a row to features whose inner products
approximate the kernel (exactly, between rows that are landmarks).  On them a linear machine with squared hinge loss is fitted by L-BFGS, whose questions
are answered like those of :mod:`labelweave.learning.networks`, and its margins on left-out folds are turned into probabilities by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass

import numpy as np

from labelweave.learning.networks import minimise
from labelweave.learning.trees import draws

#: Eigenvalues of the landmarks' kernel matrix below this share of the largest are dropped.
SMALLEST = 1e-10
CALIBRATION_FOLDS = 3
#: Values of a kernel map beyond which a question is answered without copies of it.
LARGE_MAP = 1 << 22


@dataclass(frozen=True)
class KernelMap:
    """``kernel(x, landmarks) @ root``; the identity for the linear kernel."""

    kernel: str
    gamma: float
    degree: int
    shift: float
    landmarks: np.ndarray
    root: np.ndarray | None

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return z if self.root is None else kernel_values(self.kernel, z, self.landmarks, self.gamma, self.degree, self.shift) @ self.root


def kernel_values(kernel: str, a: np.ndarray, b: np.ndarray, gamma: float, degree: int = 3, shift: float = 0.0) -> np.ndarray:
    inner = a @ b.T
    if kernel == "rbf":
        square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * inner
        return np.exp(-gamma * np.maximum(square, 0))
    if kernel == "poly":
        return (gamma * inner + shift) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * inner + shift)
    return inner


def nystrom(kernel: str, gamma: float, degree: int, shift: float, landmarks: np.ndarray) -> KernelMap:
    """The map of a kernel; directions in which the kernel is not positive (sigmoid, even powers with a negative shift) are dropped."""
    if kernel == "linear":
        return KernelMap(kernel, gamma, degree, shift, landmarks[:0], None)
    value, vector = np.linalg.eigh(kernel_values(kernel, landmarks, landmarks, gamma, degree, shift))
    keep = value > SMALLEST * max(value.max(initial=0.0), 1e-300)
    return KernelMap(kernel, gamma, degree, shift, landmarks, vector[:, keep] / np.sqrt(value[keep]))


def together(fits: list[Generator]) -> Generator[tuple, tuple[float, np.ndarray, int], list]:
    """Run fits side by side: ask ``(zeros as large as the answers, the open questions)`` and hand each fit its answer, until all have ended."""
    out: list = [None] * len(fits)
    waiting = {i: next(f) for i, f in enumerate(fits)}
    while waiting:
        _, answers, _ = yield np.zeros(sum(len(q[0]) + 2 for q in waiting.values())), list(waiting.values())
        at, asked, waiting = 0, waiting, {}
        for i, question in asked.items():
            size = len(question[0])
            loss, n = answers[at : at + 2]
            try:
                waiting[i] = fits[i].send((float(loss), answers[at + 2 : at + 2 + size].copy(), int(n)))
            except StopIteration as end:
                out[i] = end.value
            at += 2 + size
    return out


@dataclass(frozen=True)
class SvmSpec:
    """A machine: one binary problem, or one per class against the others."""

    n_classes: int = 2
    kernel: str = "rbf"
    c: float = 1.0
    degree: int = 3
    gamma: str = "scale"
    shift: float = 0.0
    landmarks: int = 256
    epochs: int = 1000
    tol: float = 1e-3
    balanced: bool = False
    seed: int = 42

    @property
    def problems(self) -> tuple[int, ...]:
        return (1,) if self.n_classes == 2 else tuple(range(self.n_classes))

    def aid(self, landmarks: np.ndarray, varying: int) -> KernelMap:
        """The kernel map from standardised landmarks; ``varying`` is the number of features that are not constant."""
        width = max(landmarks.shape[1], 1)
        gamma = 1.0 / width if self.gamma == "auto" else 1.0 / max(varying, 1)
        return nystrom(self.kernel, gamma, self.degree, self.shift, landmarks)

    def fold(self, rows: np.ndarray) -> np.ndarray:
        return (draws(self.seed, 9, rows) * CALIBRATION_FOLDS).astype(int)

    def training(self, width: int, n: int, counts: np.ndarray, aid: KernelMap) -> Generator:
        """Asks for sums over rows and returns, per problem, the weights (bias last), slope and shift of the curve."""
        size = width if aid.root is None else aid.root.shape[1]

        def fit(problem: int, fold: int):
            share = counts[problem] / max(n, 1)
            weights = (0.5 / max(1 - share, 1e-9), 0.5 / max(share, 1e-9)) if self.balanced else (1.0, 1.0)

            def mean(w, answer):
                loss, gradient, _ = answer
                flat = np.append(w[:-1], 0.0)
                return (self.c * loss + 0.5 * float(flat @ flat)) / max(n, 1), (self.c * gradient + flat) / max(n, 1)

            return minimise(self.epochs, self.tol * 1e-2, np.zeros(size + 1), mean, ("hinge", problem, fold, weights))

        def prior(w, answer):
            loss, gradient, rows = answer
            # a weak prior keeps the curve finite where the margins divide the classes
            return (loss + 1e-3 * float(w @ w)) / max(rows, 1), (gradient + 2e-3 * w) / max(rows, 1)

        # the machines do not need each other, so a pass answers a question of each; likewise the curves
        folds = (*range(CALIBRATION_FOLDS), -1)
        machines = yield from together([fit(problem, fold) for problem in self.problems for fold in folds])
        machines = [machines[at : at + len(folds)] for at in range(0, len(machines), len(folds))]
        curves = yield from together([minimise(200, 1e-7, np.array([1.0, 0.0]), prior, ("curve", p, np.stack(m[:-1]))) for p, m in zip(self.problems, machines)])
        return [(m[-1], c[0], c[1]) for m, c in zip(machines, curves)]

    def kept(self, z: np.ndarray, label: np.ndarray, rows: np.ndarray, aid: KernelMap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the questions are answered from: the mapped rows, their classes and folds."""
        return aid(z), label, self.fold(rows)

    def answer(self, question: tuple, kept: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, int]:
        """The answers to the questions that are asked together, one behind the other as loss, rows and gradient."""
        parts = []
        machines = [one for one in question[1] if one[1] == "hinge"]
        # all at once where copies of the rows outside a fold would be large
        known = iter(self.answer_machines(machines, kept) if kept[0].size > LARGE_MAP else ())
        for one in question[1]:
            loss, gradient, n = next(known, None) if one[1] == "hinge" and kept[0].size > LARGE_MAP else self.answer_one(one, kept)
            parts += [[loss, n], gradient]
        return 0.0, np.concatenate(parts), len(kept[1])

    def answer_machines(self, asked: list[tuple], kept: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[float, np.ndarray, int]]:
        """As :func:`answer_one` for several machines, which see the mapped rows together."""
        if not asked:
            return []
        phi, label, fold = kept
        use = np.stack([fold != q[3] for q in asked], 1)
        positive = np.stack([label == q[2] for q in asked], 1)
        weight = np.where(positive, [q[4][1] for q in asked], [q[4][0] for q in asked]) * use
        sign = np.where(positive, 1.0, -1.0)
        w = np.stack([q[0] for q in asked], 1)
        short = np.maximum(0.0, 1 - sign * (phi @ w[:-1] + w[-1]))
        pull = -2 * weight * short * sign
        loss, gradient = (weight * short**2).sum(0), np.vstack([phi.T @ pull, pull.sum(0)])
        return [(float(loss[i]), gradient[:, i], int(use[:, i].sum())) for i in range(len(asked))]

    def answer_one(self, question: tuple, kept: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, int]:
        w, kind, problem = question[:3]
        phi, label, fold = kept
        positive = label == problem
        if kind == "curve":
            parts = question[3]
            margin = np.einsum("ij,ij->i", np.hstack([phi, np.ones((len(phi), 1))]), parts[fold])
            t = np.where(positive, 1.0, -1.0) * (w[0] * margin + w[1])
            pull = -np.where(positive, 1.0, -1.0) / (1 + np.exp(np.clip(t, -500, 500)))
            return float(np.logaddexp(0, -t).sum()), np.array([(pull * margin).sum(), pull.sum()]), len(phi)
        use = fold != question[3]
        weight = np.where(positive[use], question[4][1], question[4][0])
        sign = np.where(positive[use], 1.0, -1.0)
        short = np.maximum(0.0, 1 - sign * (phi[use] @ w[:-1] + w[-1]))
        pull = -2 * weight * short * sign
        return float((weight * short**2).sum()), np.append(pull @ phi[use], pull.sum()), int(use.sum())

    def model(self, mean: np.ndarray, spread: np.ndarray, final: list, aid: KernelMap) -> SvmModel:
        return SvmModel(self, mean, spread, final, aid)


@dataclass
class SvmModel:
    spec: SvmSpec
    mean: np.ndarray
    spread: np.ndarray
    fitted: list[tuple[np.ndarray, float, float]]
    aid: KernelMap

    def margins(self, x: np.ndarray) -> np.ndarray:
        phi = self.aid(np.nan_to_num((x - self.mean) / self.spread, nan=0.0))
        return np.stack([phi @ w[:-1] + w[-1] for w, _, _ in self.fitted], 1)

    def proba(self, x: np.ndarray) -> np.ndarray:
        slope, shift = (np.array([f[k] for f in self.fitted]) for k in (1, 2))
        p = 1 / (1 + np.exp(-np.clip(self.margins(x) * slope + shift, -500, 500)))
        if self.spec.n_classes == 2:
            return np.hstack([1 - p, p])
        return p / np.maximum(p.sum(1, keepdims=True), 1e-300)
