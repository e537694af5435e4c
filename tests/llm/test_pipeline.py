"""The pipeline's stages on planted rows, and its packed ids against the kept texts."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import tiktoken

from labelweave.llm import tokens

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    planted = spark.createDataFrame(
        [(10**6 + i, t, "en", "p", len(t or "")) for i, t in enumerate([None, "", "123 456", docs.first().text, "the and password=hunter2hunter2 of the"])], docs.schema
    )
    docs = docs.unionByName(planted)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, FOLDER)
    assert kept.columns == columns and kept.filter("doc_id < 1000000").count() == before
    assert {r.doc_id for r in kept.filter("doc_id >= 1000000").collect()} == {10**6 + 3, 10**6 + 4}
    assert stages["toxicity"](spark, kept, FOLDER).columns == columns
    single = stages["near_duplicates"](spark, kept, FOLDER)
    assert single.columns == columns and not single.filter(f"doc_id = {10**6 + 3}").count()
    clean = stages["secrets"](spark, single, FOLDER)
    assert clean.columns == columns and clean.count() == single.count()
    assert not clean.filter("text LIKE '%hunter2hunter2%'").count()


def test_run_packs_what_the_stages_kept(spark):
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=tokens.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    )
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, FOLDER)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc_id, rows in pieces.items():
        ids = [i for r in sorted(rows, key=lambda r: r.start) for i in memoryview(bytes(r.ids)).cast("I")]
        assert ids == [*encoding.encode_ordinary(texts[doc_id]), 0]
