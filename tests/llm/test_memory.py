"""What batches, caches and very long texts take."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from labelweave.llm import bpe, common, language, minhash, tokens


def test_small_batches_hold_rows_and_bytes():
    texts = ["a" * 300_000, None, "b" * 5_000_000, "c", "d" * 900_000] + ["é"] * 1500
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["t", "i"]).slice(1)
    parts = list(common.small_batches(batch, "t"))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(1, len(texts)))
    for p in parts:
        sizes = [len((t or "").encode()) for t in p.column("t").to_pylist()]
        assert p.num_rows <= common.BATCH_ROWS and (sum(sizes) <= common.BATCH_BYTES or sum(s > 0 for s in sizes) == 1)


def test_remembered_stays_in_its_budget():
    class Lengths(common.Remembered):
        def __missing__(self, key):
            return self.keep(key, len(key), len(key))

    cache = Lengths(20_000)
    for i in range(2000):
        assert cache[f"{i:05d}" * 8] == 40
    assert 0 < len(cache) <= 100 and cache["x" * 10_000] == 10_000 and "x" * 10_000 not in cache


@pytest.fixture
def model():
    rng = np.random.default_rng(0)
    size = 1 << language.TRIGRAM_BITS
    return language.LanguageModel(("a", "b", "c", "d"), rng.normal(-6, 1, (size, 4)).astype(np.float32), rng.normal(-1, 0.1, (1 << 16, 4)).astype(np.float32))


def test_windows_do_not_change_the_language(model, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdéß-"), rng.integers(1, 9))) for _ in range(n)) for n in (3000, 1, 40)]
    whole = language.infer(texts, model)
    monkeypatch.setattr(language, "WINDOW", 500)
    monkeypatch.setattr(language, "WORDS", 64)
    assert len(list(language.windows(texts[0]))) > 10 and "".join(language.windows(texts[0])) == texts[0]
    parted = language.infer(texts, model)
    assert parted["lang_pred"] == whole["lang_pred"] and parted["languages"] == whole["languages"]
    assert np.allclose(parted["score"], whole["score"], rtol=5e-3)  # a window is framed like a text


@pytest.mark.parametrize("text", ["some words of a text " * 1_000_000, "不" * 7_000_000])
def test_language_of_a_text_of_20_mb(model, text):
    tracemalloc.start()
    got = language.infer([text], model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["lang_pred"][0] in model.languages and peak < 250 << 20


def test_clashing_columns_of_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "p", "q", 0), (1, text, "p", "q", 0), (2, text, "p", "q", 0), (3, "other words of another text here", "p", "q", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, _cls string, c0 int")
    got = minhash.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_bpe_of_texts_without_spaces():
    """Different long words of characters of three bytes each, which need many rounds, in one batch."""
    rng = np.random.default_rng(2)
    texts = ["，".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 30)) for _ in range(160)) for _ in range(64)]
    codec = bpe.Codec(tokens.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for (n, ids, raw), text in zip(codec.code(texts), texts):
        want = encoding.encode_ordinary(text)
        assert n == len(want) and ids.decode() == " ".join(map(str, want)) and raw == text.encode()
