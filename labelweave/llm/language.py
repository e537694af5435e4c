"""Language identification as a mixture of languages fitted by expectation maximisation.

A language is a byte trigram model (probability of a byte after two others) counted over *all* learning
documents.  A document's words are drawn from a mixture of languages: EM estimates the proportions from the
words' likelihoods, and the set of languages is the one with the best penalised likelihood among the nested
sets of the most frequent languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import filter_texts, fold, map_texts, releasing, small_batches
from labelweave.runtime import stage

#: Trigrams are hashed to so many bits; pairs of bytes are kept exactly.
TRIGRAM_BITS = 17
#: Weight of the uniform byte prior in a trigram's probability.
PRIOR = 2.0
ROUNDS = 8
#: Lowest share at which a further language is tried at all.
MIN_SHARE = 0.01
UNKNOWN = "und"

#: Code points of a text that are scored at a time, and words whose shares are added at a time.
WINDOW, WORDS = 1 << 17, 1 << 15

_LETTER = regex.compile(r"\p{L}")
_BETWEEN = re.compile(r"[^A-Za-z\x80-\U0010ffff]")
#: ASCII letters in lower case, other ASCII bytes as a space, the rest as they are
_FOLDED = bytes(
    i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256)
)


def windows(text: str) -> Iterator[str]:
    """A text in parts of about ``WINDOW`` code points that end between words; a single word that is longer than another window is parted."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        if end < len(text):
            gap = _BETWEEN.search(text, end, end + WINDOW)
            end = gap.end() if gap else end + WINDOW
        yield text[at:end]
        at = end


def _runs(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Windows of the texts, with each one's text number, in lists of about ``WINDOW`` code points."""
    held, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for part in windows(text):
            held.append(part)
            owner.append(i)
            size += len(part)
            if size >= WINDOW:
                yield held, owner
                held, owner, size = [], [], 0
    if held:
        yield held, owner


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each framed by spaces, and where each text begins."""
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass").translate(_FOLDED) + b"  " for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), starts


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and hashed trigram at each position but the last two, which repeat."""
    a = codes.astype(np.uint32)
    pair = (a[:-2] << 8) | a[1:-1]
    gram = ((pair << 8) | a[2:]) * np.uint32(2654435761) >> np.uint32(32 - TRIGRAM_BITS)
    return pair.astype(np.int32), gram.astype(np.int32)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in ascending order and ``log_p[language, trigram] - log_q[language, bigram]``."""

    languages: tuple[str, ...]
    log_p: np.ndarray
    log_q: np.ndarray


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    for part in small_batches(batch, "text"):
        by: dict[str, list[str]] = {}
        for name, value in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            by.setdefault(name, []).append(value)
        yield from by.items()


def fit_languages(docs: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """Count the n-grams of every document with a text and a language.

    Counts are summed in each task, then by Spark; the driver gets one row per language and n-gram, at most
    ``languages * (2**16 + 2**TRIGRAM_BITS)``, however many documents there are.
    """
    source = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        size = 1 << 16
        for batch in batches:
            for name, texts in _by_language(batch):
                table = tables.setdefault(name, np.zeros(size + (1 << TRIGRAM_BITS), np.int64))
                for parts, _ in _runs(texts):
                    pair, gram = _grams(_codes(parts)[0])
                    table[:size] += np.bincount(pair, minlength=size)
                    table[size:] += np.bincount(gram, minlength=1 << TRIGRAM_BITS)
        for name, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])],
                names=["lang", "gram", "n"],
            )

    counts = source.mapInArrow(releasing(count), "lang string, gram int, n bigint")
    rows = stage(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams").toArrow()
    names = tuple(sorted(set(rows.column("lang").to_pylist())))
    size = 1 << 16
    table = np.zeros((len(names), size + (1 << TRIGRAM_BITS)))
    if names:
        order = {name: i for i, name in enumerate(names)}
        which = np.array([order[x] for x in rows.column("lang").to_pylist()])
        table[which, rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return LanguageModel(
        names,
        np.log(table[:, size:] + PRIOR / 64).T.astype(np.float32).copy(),
        np.log(table[:, :size] + PRIOR).T.astype(np.float32).copy(),
    )


def _word_scores(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likelihoods of all words relative to their likeliest language, words per text, and log-likelihoods per text."""
    words, owners = [], []
    single = np.zeros((len(texts), len(model.languages)))
    for parts, owner in _runs(texts):
        codes, begins = _codes(parts)
        pair, gram = _grams(codes)
        # words: from the space before a word to the next such space
        space = codes == 32
        word = np.flatnonzero(space[:-2] & ~space[1:-1])
        if not len(word):
            continue
        ll = np.add.reduceat(model.log_p[gram] - model.log_q[pair], word, axis=0).astype(np.float64)
        own = np.repeat(np.array(owner), np.diff(np.searchsorted(word, begins)))
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        single[own[first]] += np.add.reduceat(ll, first, axis=0)
        words.append(np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60.0)).astype(np.float32))
        owners.append(own)
    n = np.bincount(np.concatenate(owners), minlength=len(texts)) if owners else np.zeros(len(texts), int)
    return np.concatenate(words) if words else np.empty((0, single.shape[1]), np.float32), n, single


def _added(e: np.ndarray, n: np.ndarray, value) -> np.ndarray:
    """Sums per text of what ``value(words, text numbers)`` gives, some words at a time."""
    ends, out = np.cumsum(n), None
    for at in range(0, len(e), WORDS):
        part = e[at : at + WORDS]
        doc = np.searchsorted(ends, np.arange(at, at + len(part)), "right")
        each = value(part, doc)
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        if out is None:
            out = np.zeros((len(n), *each.shape[1:]))
        out[doc[first]] += np.add.reduceat(each, first, axis=0)
    return out


def _mixture(e: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """EM rounds from the proportions ``share``; zero proportions stay zero."""
    for _ in range(ROUNDS):

        def parts(words, doc, share=share):
            r = share[doc] * words
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            return r

        share = _added(e, n, parts) / n[:, None]
    return share


def _likelihood(e: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    return _added(e, n, lambda words, doc: np.log(np.maximum((share[doc] * words).sum(1), 1e-300)))


def infer(texts: list[str], model: LanguageModel) -> dict[str, list]:
    """Per text: the language with the largest share, its score, the language set and its shares."""
    k = len(model.languages)
    out = {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "languages": [[] for _ in texts], "shares": [[] for _ in texts]}
    use = [i for i, t in enumerate(texts) if k and _LETTER.search(t)]
    if not use:
        return out
    # every letter is in a word: the bytes over 127 are kept
    e, n, single = _word_scores([texts[i] for i in use], model)
    share = _mixture(e, n, np.full((len(use), k), 1.0 / k))
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best = np.where(rank == 0, 1.0, 0.0)
    several = np.flatnonzero(np.sort(share, axis=1)[:, -2] >= MIN_SHARE) if k > 1 else np.array([], int)
    if len(several):
        mixed = np.zeros(len(use), bool)
        mixed[several] = True
        e2, n2 = e[np.repeat(mixed, n)], n[several]
        value = np.full(len(several), -np.inf)
        for size in range(1, k + 1):
            # the languages of this set start from their share in the full mixture
            inside = np.where(rank[several] < size, np.maximum(share[several], 1e-6), 0.0)
            now = _mixture(e2, n2, inside / inside.sum(1, keepdims=True))
            penalised = _likelihood(e2, n2, now) - 0.5 * (size - 1) * np.log(n2 + 1.0) * 2
            better = penalised > value
            value = np.where(better, penalised, value)
            best[several[better]] = now[better]
    # how sure the leading language is against any single other one
    odds = np.exp(np.clip(single - single.max(1, keepdims=True), -60, 0))
    sure = odds / odds.sum(1, keepdims=True)
    lead = best.argmax(1)
    for j, i in enumerate(use):
        held = [x for x in order[j] if best[j, x] > 0]
        out["lang_pred"][i] = model.languages[lead[j]]
        out["score"][i] = float(min(1.0, best[j, lead[j]] * (sure[j, lead[j]] if len(held) == 1 else 1.0)))
        out["languages"][i] = [model.languages[x] for x in held]
        out["shares"][i] = [float(best[j, x]) for x in held]
    return out


def identify_languages(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred, score, languages, shares`` for every document.

    A null text, an empty one, one without any letter, or an empty model gives ``und`` with score 0 and no
    languages.  Ties of shares go to the language that sorts first.  Rows are independent: repeated ids
    keep a row each, and extra columns are ignored unless named in ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: infer(texts, shared.value)

    return map_texts(
        docs, make, "lang_pred string, score double, languages array<string>, shares array<double>", keep
    )


def language_report(docs: DataFrame) -> DataFrame:
    """Learn outside the held-out fold and predict every document."""
    model = fit_languages(docs.filter(fold() != 0))
    found = identify_languages(docs, model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The documents, all columns, whose language is known with at least ``min_score``.

    ``und`` documents go; the model is learned from the given documents' own ``lang``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_languages(docs.filter(fold() != 0)))

    def make():
        def accept(texts):
            found = infer(texts, shared.value)
            return [p != UNKNOWN and s >= min_score for p, s in zip(found["lang_pred"], found["score"])]

        return accept

    return filter_texts(docs, make)
