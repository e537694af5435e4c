"""Spelling groups against brute force, and on awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelweave.llm import spelling

DOC = "doc_id bigint, text string"


def brute_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out, forms = {}, {}
    for w, n in words.items():
        near = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * n:
            forms[w] = best
        out[w] = (n, len(near))
    result = set()
    for w, (n, k) in out.items():
        root = w
        while root in forms:
            root = forms[root]
        result.add((w, forms.get(w), root, n, k, words[forms[w]] if w in forms else None))
    return result


def got(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(5)


@pytest.mark.parametrize("group", [4, 256])
def test_groups_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(group)
    rows = []
    base = ["".join(rng.choice("abàé") for _ in range(rng.randint(6, 11))) for _ in range(60)]
    for i in range(400):
        words = []
        for _ in range(30):
            w = list(base[min(int(rng.expovariate(0.12)), 59)])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é"])
            words.append("".join(w).title() if rng.random() < 0.2 else "".join(w))
        rows.append((i, " ".join(words)))
    have = got(spelling.spelling_groups(frame(spark, rows)))
    want = brute(rows)
    assert len(have) == len(want) and set(have) == want
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)


def test_pairs_at_every_place(spark):
    """Each edit of each place of words of several lengths is found, and counted once."""
    words = set()
    for w in ("abcdefg", "abcdefgh", "aaaaaaaa", "abababababab", "abcdefghijklmnopqrstu"):
        words.add(w)
        for i in range(len(w) + 1):
            words |= {w[:i] + "z" + w[i:], w[:i] + "a" + w[i:]}
            if i < len(w):
                words |= {w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 7)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint")
    have = {r.word: r.n_near for r in spelling.near_words(df).collect()}
    assert have == {w: sum(one_edit(w, v) for v in words if v != w) for w in words}


def test_test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    have = got(spelling.spelling_groups(docs))
    assert len(have) == len(set(have)) and set(have) == brute(rows)


def test_awkward_rows(spark):
    long = "x" * 20_000
    rows = [
        (1, None), (2, ""), (3, " \n 123"), (4, "straßen STRASSEN Straßen straßen"), (4, "straßen STRASSEN Straßen straßen"), (None, "ÀÉÎõüñç ÀÉÎõüñç"),
        (5, f"{long} {long}y {long} {long}y"), (6, "ﬁnance ǅabcdefg words1words1 short"), (7, "wordswordsa " * 300_000),
    ]
    df = frame(spark, rows).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("key", F.lit(None).cast("string"))
    have = got(spelling.spelling_groups(df))
    assert set(have) == brute(rows) and len(have) == len(set(have))
    assert spelling.spelling_groups(df.limit(0)).count() == 0
