"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts, one from ordinary words and one from the spans
that mark toxic texts.  Every window (one word with its surrounding spaces) is compressed with either
dictionary; the window's margin is the number of bytes that the toxic dictionary saves.  A document counts its windows with a
margin above a calibrated threshold, and a logistic curve over that count and the largest margin gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import Remembered, filter_texts, fold, labelled_sample, map_texts

#: Documents of each class that are used for fitting, at most.
SAMPLE_PER_CLASS = 2000
#: Bytes of each dictionary.
DICTIONARY_BYTES = 49_152
#: Bytes of the pieces that are compared between the classes when toxic spans are chosen.
PIECE = 5
#: A piece marks toxic texts when it is in this many of them and so many times likelier there.
MIN_DOCS, MIN_RATIO = 3, 20.0
#: and when it stands between so many different pairs of words.
MIN_PLACES = 4
#: Put after every window and at the end of both dictionaries: the fixed cost of a first match is paid by it
#: with either dictionary, and matches are also sought in the last bytes of a short window.
ANCHOR = bytes(range(1, 17))
#: Bytes of windows and margins that a task remembers.
CACHE_BYTES = 32 << 20
LEVEL = 3


def _words(text: str) -> list[bytes]:
    return [b" " + w + b" " for w in text.encode("utf-8", "surrogatepass").lower().split()]


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, float, float]  # bias, log of the number of marked windows + 1, largest margin


class Margins(Remembered):
    """Window -> bytes saved by the toxic dictionary; forgets everything when it is full."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__(CACHE_BYTES)

        def compressor(content: bytes):
            # content that does not start with the magic number of trained dictionaries serves as plain history
            return zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(content + ANCHOR),
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )

        self._ordinary, self._toxic = compressor(ordinary).compress, compressor(toxic).compress

    def __missing__(self, window: bytes) -> int:
        anchored = window + ANCHOR
        return self.keep(window, len(self._ordinary(anchored)) - len(self._toxic(anchored)), len(window))


def _pieces(window: bytes):
    return {window[i : i + PIECE] for i in range(len(window) - PIECE + 1)}


def _toxic_spans(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Counter:
    """Spans of the windows of toxic texts that are covered by marking pieces, with their counts."""
    seen, elsewhere = Counter(), Counter()
    for words in toxic:
        seen.update(set().union(*map(_pieces, set(words))) if words else ())
    candidates = {p for p, n in seen.items() if n >= MIN_DOCS}
    for words in ordinary:
        elsewhere.update(candidates.intersection(*[set().union(*map(_pieces, set(words)))]) if words else ())
    scale = MIN_RATIO * (len(toxic) + 1) / (len(ordinary) + 1)
    likely = {p for p in candidates if seen[p] + 0.5 > scale * (elsewhere[p] + 0.5)}
    # copies of a text repeat its chance pieces, but always between the same words
    around: dict[bytes, set] = {}
    for words in toxic:
        for i, w in enumerate(words):
            for p in likely.intersection(_pieces(w)):
                around.setdefault(p, set()).add((tuple(words[max(i - 1, 0) : i]), tuple(words[i + 1 : i + 2])))
    marks = {p for p, places in around.items() if len(places) >= MIN_PLACES}
    spans: Counter = Counter()
    for words in toxic:
        for w in words:
            at = [i for i in range(len(w) - PIECE + 1) if w[i : i + PIECE] in marks]
            if at:
                spans[w[at[0] : at[-1] + PIECE]] += 1
    return spans


def _profile(text: str, margins: Margins, threshold: int) -> tuple[float, float]:
    most, marked = 0, 0
    for margin in map(margins.__getitem__, _words(text)):
        if margin > 0:
            most = max(most, margin)
            marked += margin >= threshold
    return math.log1p(marked), float(most)


def fit_toxicity(sample: list[tuple[str, int]]) -> ToxicityModel:
    """Fit from ``(text, 0 or 1)`` rows; without rows of both classes every score is the share of toxic rows."""
    toxic = [_words(t) for t, y in sample if y]
    ordinary = [_words(t) for t, y in sample if not y]
    prior = (len(toxic) + 0.5) / (len(sample) + 1.0)
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", 1, (math.log(prior / (1 - prior)), 0.0, 0.0))
    spans = _toxic_spans(toxic, ordinary)
    common: Counter = Counter()
    for words in ordinary:
        common.update(words)

    def content(ranked: list[bytes], most: int = DICTIONARY_BYTES) -> bytes:
        """The foremost items that fit, the most important ones last, where matches are cheapest."""
        size, chosen = 0, []
        for item in ranked:
            size += len(item)
            if size > most:
                break
            chosen.append(item)
        return b"".join(reversed(chosen))

    rank = lambda c: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))]
    model = ToxicityModel(content(rank(common)), content([s for s in rank(spans) if spans[s] > 1]), 1, (0.0, 0.0, 0.0))
    margins = Margins(model.ordinary, model.toxic)
    y = np.array([label for _, label in sample], float)
    # the threshold that separates documents best by their largest margin, the larger on ties
    most = np.array([_profile(t, margins, 1)[1] for t, _ in sample])
    rates = {t: (np.mean(most[y == 1] >= t) - np.mean(most[y == 0] >= t)) for t in range(1, int(most.max(initial=1)) + 1)}
    threshold = max(rates, key=lambda t: (round(rates[t], 6), t))
    x = np.array([[1.0, *_profile(t, margins, threshold)] for t, _ in sample])
    # Newton steps of a logistic regression; classes weigh the same so that a half is the even point
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1.0, 0.05])
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - np.array([1e-3, 1.0, 0.05]) * w)
    return ToxicityModel(model.ordinary, model.toxic, threshold, tuple(float(v) for v in w))


def score_texts(texts: list[str], model: ToxicityModel, margins: Margins) -> list[float]:
    bias, many, most = model.weights
    return [
        1 / (1 + math.exp(-max(-30.0, min(30.0, bias + many * a + most * b))))
        for a, b in (_profile(t, margins, model.threshold) for t in texts)
    ]


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Fit on at most ``2 * per_class`` labelled documents outside the held-out fold."""
    rows = labelled_sample(docs, labels, "toxic", per_class).select("doc_id", "text", "label").collect()
    rows = sorted((r.doc_id, r.text or "", int(r.label)) for r in rows)
    return fit_toxicity([(t, y) for _, t, y in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``score`` for every document; null and empty texts score as texts without marked windows.

    Rows are independent, so repeated ids keep a row each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        margins = Margins(shared.value.ordinary, shared.value.toxic)
        return lambda texts: {"score": score_texts(texts, shared.value, margins)}

    return map_texts(docs, make, "score double", keep)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, learn_toxicity(docs, labels))
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents, all columns, that score below ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn_toxicity(docs, labels))

    def make():
        margins = Margins(shared.value.ordinary, shared.value.toxic)
        return lambda texts: [s < limit for s in score_texts(texts, shared.value, margins)]

    return filter_texts(docs, make)
