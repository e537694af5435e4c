"""Grouping of spelling variants by dynamic programming over sorted word lists.

Two words within one edit keep at least half of the shorter one before the edit or behind it, and the same holds again for what is left.  Words are
dealt by such halves of halves, so each group shares a prefix and a suffix.  Inside a group the middles are sorted; the rows of the banded edit matrix
are computed once per range of words with a common prefix (adjacent longest common prefixes give the ranges), and a range whose prefix
is already more than one edit away is left with all its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.runtime import stage

#: A lower-cased run is damaged when this number divides its hash.
DAMAGE = 31
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10
#: A group of more words than this is dealt once more, by the halves of what its words do not share.
GROUP = 256
#: Words (and their code points) of the groups that are scanned together.
SCAN_WORDS, SCAN_BYTES = 16_384, 1 << 20
#: Code points that are searched for words at a time.
WINDOW = 1 << 20
#: Code points of the words that a task counts before it hands its counts on.
COUNTED = 4 << 20

_BEYOND = re.compile("[^a-zÀ-ÿ]")


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Spans of a text that no run of letters crosses."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        if end < len(text):
            stop = _BEYOND.search(text, end)
            end = stop.start() if stop else len(text)
        yield at, min(end, len(text))
        at = end


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``word, n``: occurrences of every word of at least ``least`` code points, over whole texts.

    Words are maximal runs of letters, A-Z lower-cased; of every run whose hash with the document's id 31 divides, one code point is
    deleted.  Runs that are shorter than ``least`` cannot become words.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                start = zlib.crc32(f"{key}:".encode())
                # bytes are lower-cased in A-Z only
                text = text.as_py().encode().lower().decode()
                for at, end in _windows(text):
                    for run, n in Counter(runs.findall(text, at, end)).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % DAMAGE == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                            if len(run) < least:
                                continue
                        if run not in held:
                            size += len(run) + 8
                        held[run] += n
                    if size > COUNTED:
                        yield close()
                        held.clear()
                        size = 0
        if held:
            yield close()

    source = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    return source.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def shared_parts(m: int, path: str) -> tuple[int, int, int]:
    """Lengths of the prefix and the suffix that a group's words share, and the common prefix at which its pairs belong to another group.

    ``m`` is the shorter word's length.  Each step of the path takes half of what is left at the front (P) or at the end (S); a pair
    that could go both ways is found in front.
    """
    p = s = 0
    other = 1 << 30
    for step in path:
        h = (m - p - s) // 2
        if step == "P":
            p += h
        else:
            other = min(other, p + h)
            s += h
    return p, s, other


def first_records(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``key, word, n``: each word in its groups, as the shorter (or equal) and as the longer member of a pair, after two steps."""
    length = F.length("word")
    lengths = F.filter(F.array(length, length - 1), lambda m: m >= least)
    classes = words.select("word", "n", F.explode(lengths).alias("m"))
    half = F.expr("m div 2")
    rest = F.expr("(m - m div 2) div 2")
    ways = [("PP", half + rest, F.lit(0)), ("PS", half, rest), ("SP", rest, half), ("SS", F.lit(0), half + rest)]
    keys = [F.concat_ws("|", "m", F.lit(path), F.left("word", p), F.right("word", s)) for path, p, s in ways]
    return classes.select(F.explode(F.array(*keys)).alias("key"), "word", "n")


class Scan:
    """Words of whole groups that wait to be scanned together."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words: list[str] = []
        self.counts: list[int] = []
        self.groups: list[tuple[int, int, int, int, int]] = []  # words, m, prefix, suffix, other
        self.size = 0
        self.widest = 0

    def full(self) -> bool:
        return len(self.words) >= SCAN_WORDS or len(self.words) * self.widest >= SCAN_BYTES

    def add(self, key: str, words: list[str], counts: list[int]) -> None:
        m, path = key.split("|", 2)[:2]
        p, s, other = shared_parts(int(m), path)
        self.groups.append((len(words), int(m), p, s, other))
        self.words += words
        self.counts += counts
        self.widest = max(self.widest, int(m) + 1 - p - s)

    def near(self) -> pa.RecordBatch:
        """``word, n_near, best_n, best`` for the words with near words in their groups."""
        sizes, m, p, s, other = (np.array(c) for c in zip(*self.groups))
        group = np.repeat(np.arange(len(sizes)), sizes)
        length = np.array([len(w) for w in self.words])
        codes = np.frombuffer("".join(self.words).encode("latin-1"), np.uint8)
        start = np.cumsum(length) - length + p[group]
        middle = length - (p + s)[group]
        width = int(middle.max())
        at = np.arange(width)
        inside = at < middle[:, None]
        chars = np.where(inside, codes[np.minimum(start[:, None] + at, len(codes) - 1)], 0).astype(np.uint8)
        head = group.astype(">u4").view(np.uint8).reshape(-1, 4)
        order = np.argsort(np.hstack([head, chars]).view(f"S{width + 4}").ravel(), kind="stable")
        # from here on rows are sorted by (group, middle); ``order`` is the rank of the whole word inside its group
        chars, middle, group = chars[order], middle[order], group[order]
        q, v = _near_pairs(chars, middle, group, (m - p - s)[group])
        # pairs that share more of the front than this group's path says are found by another group
        same = chars[q] == chars[v]
        common = np.where(same.all(1), width, same.argmin(1))
        short = common >= np.minimum(middle[q], middle[v])
        common = common + p[group[q]]
        for i in np.flatnonzero(short):
            common[i] = _common_prefix(self.words[order[q[i]]], self.words[order[v[i]]])
        own = common < other[group[q]]
        q, v = order[q[own]], order[v[own]]
        q, v = np.concatenate([q, v]), np.concatenate([v, q])
        counts = np.array(self.counts)
        ranked = np.lexsort([v, -counts[v], q])
        q, v = q[ranked], v[ranked]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.array([], int)
        n_near = np.diff(np.append(first, len(q)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.words[i] for i in q[first]], pa.string()), pa.array(n_near, pa.int64()),
                pa.array(counts[v[first]], pa.int64()), pa.array([self.words[i] for i in v[first]], pa.string()),
            ],
            names=["word", "n_near", "best_n", "best"],
        )


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _near_pairs(chars: np.ndarray, length: np.ndarray, group: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(q, v)``, ``q < v``, of sorted rows of one group within one edit, unless both are longer than ``shorter``.

    All words are queries at once.  The state of a query in a range of words with a common prefix is one row of the edit matrix, cut to
    the three columns around the diagonal.
    """
    n, width = chars.shape
    new = np.append(True, group[1:] != group[:-1])
    differ = chars[1:] != chars[:-1]
    lcp = np.append(-1, np.where(differ.any(1), differ.argmax(1), width))
    lcp[new] = -1
    ends = np.append(np.flatnonzero(new)[1:], n)
    # a column before the first and two behind the last, which match nothing
    padded = np.zeros((n, width + 3), np.uint8)
    padded[:, 1 : width + 1] = chars
    q = np.arange(n)
    low, high = np.flatnonzero(new)[np.cumsum(new) - 1], ends[np.cumsum(new) - 1]
    a, b, c = (np.full(n, x, np.uint8) for x in (2, 0, 1))
    found_q, found_v = [], []
    for depth in range(width + 1):
        # a range's first word may end here
        offset = length[q] - depth
        value = np.where(offset == 0, b, np.where(offset == 1, c, np.where(offset == -1, a, 2)))
        hit = (length[low] == depth) & (low > q) & (value <= 1) & ((length[q] == shorter[q]) | (length[low] == shorter[q]))
        found_q.append(q[hit])
        found_v.append(low[hit])
        if depth == width:
            break
        # ranges with one more code point in common, but for those wholly at or before the query
        starts = np.flatnonzero(lcp < depth + 1)
        number = np.cumsum(lcp < depth + 1)
        first = number[low] - 1
        several = number[high - 1] - first
        parent = np.repeat(np.arange(len(q)), several)
        child = np.arange(len(parent)) - np.repeat(np.cumsum(several) - several, several) + first[parent]
        ends_of = np.append(starts[1:], n)
        low, high = starts[child], ends_of[child]
        keep = (high - 1 > q[parent]) & (chars[low, depth] != 0)
        parent, low, high = parent[keep], low[keep], high[keep]
        q = q[parent]
        letter = chars[low, depth]
        a, b, c = a[parent], b[parent], c[parent]
        a, old = np.minimum(a + (letter != padded[q, depth]), b + 1), b
        b = np.minimum(np.minimum(old + (letter != padded[q, depth + 1]), c + 1), a + 1)
        c = np.minimum(c + (letter != padded[q, depth + 2]), b + 1)
        alive = np.flatnonzero((a <= 1) | (b <= 1) | (c <= 1))
        q, low, high = q[alive], low[alive], high[alive]
        a, b, c = (np.minimum(x[alive], 2).astype(np.uint8) for x in (a, b, c))
    return np.concatenate(found_q), np.concatenate(found_v)


def scan_groups(records: DataFrame) -> DataFrame:
    """Scan the groups of ``key, word, n``: rows ``word, n_near, best_n, best``, and as rows with a ``key`` (and ``n``) the groups to deal again."""
    names = ["key", "word", "n", "n_near", "best_n", "best"]
    schema = "key string, word string, n bigint, n_near bigint, best_n bigint, best string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan()
        again: list[tuple[str, str, int]] = []
        held_key, words, counts, split = None, [], [], False

        def results() -> Iterator[pa.RecordBatch]:
            if scan.words:
                got = scan.near()
                scan.clear()
                if got.num_rows:
                    none = [pa.nulls(got.num_rows, t) for t in (pa.string(), pa.int64())]
                    yield pa.RecordBatch.from_arrays([none[0], got.column(0), none[1], *got.columns[1:]], names=names)
            if again:
                columns = [pa.array(c) for c in zip(*again)]
                again.clear()
                none = [pa.nulls(len(columns[0]), t) for t in (pa.int64(), pa.int64(), pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *none], names=names)

        def deal() -> None:
            """The held words go to the group's two halves."""
            m, path = held_key.split("|", 2)[:2]
            for step in "PS":
                p, s, _ = shared_parts(int(m), path + step)
                again.extend((f"{m}|{path}{step}|{w[:p]}|{w[len(w) - s :]}", w, n) for w, n in zip(words, counts))
            words.clear()
            counts.clear()

        def close() -> None:
            if split:
                deal()
            elif len(words) > 1:
                scan.add(held_key, words, counts)

        for batch in batches:
            keys, some, n = (batch.column(batch.schema.get_field_index(k)) for k in ("key", "word", "n"))
            keys, some, n = keys.to_pylist(), some.to_pylist(), n.to_pylist()
            for key, word, count in zip(keys, some, n):
                if key != held_key:
                    close()
                    held_key, words, counts, split = key, [], [], False
                    if scan.full() or len(again) > SCAN_WORDS:
                        yield from results()
                words.append(word)
                counts.append(count)
                if len(words) > GROUP:
                    if not split:
                        m, path = key.split("|", 2)[:2]
                        p, s, _ = shared_parts(int(m), path)
                        # words that share all but one or two code points are few enough
                        split = int(m) - p - s >= 2
                    if split:
                        deal()
                        if len(again) > SCAN_WORDS:
                            yield from results()
        close()
        yield from results()

    return records.repartition("key").sortWithinPartitions("key", "word").mapInArrow(run, schema)


def near_words(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``word, n, n_near, best_n, best`` for every row of ``word, n`` (distinct, ``least`` code points or more)."""
    records = first_records(words, least)
    found = []
    while True:
        scanned = stage(scan_groups(records), "near_words")
        found.append(scanned.filter("key IS NULL").select("word", F.lit(None).cast("bigint").alias("n"), "n_near", "best_n", "best"))
        records = scanned.filter("key IS NOT NULL").select("key", "word", "n")
        # each turn halves what the words of a group do not share
        if records.isEmpty():
            break
    rows = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("best_n"), F.lit(None).cast("string").alias("best"))
    for more in found:
        rows = rows.unionByName(more)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("rank"), "best")))
    return (
        rows.groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
        .select("word", "n", "n_near", (-F.col("b.rank")).alias("best_n"), F.col("b.best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for each row of ``word, form``: the last word reached by following forms.

    Every round doubles the steps followed.  A form occurs several times as often as its word, so there are no circles, and few words
    come to one root, since it has only so many words within an edit.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the documents.

    Null and empty texts have no words.  Repeated rows count as often as they occur, with their own damage: a null id counts as the
    empty text in the hash.  Of equally frequent near words the smallest in code-point order is the form.  Other columns are ignored; an
    empty table gives no rows.
    """
    words = stage(word_counts(docs, least).filter(F.col("n") >= least_count), "words")
    near = near_words(words, least)
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    formed = stage(near.select("word", form.alias("form"), "n", "n_near", F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "forms")
    found = roots(formed.filter("form IS NOT NULL"))
    return formed.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
