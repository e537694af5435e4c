"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from labelweave.llm import bpe, embeddings, language, minhash, packing, quality, secrets, simhash, spelling, toxicity, warc, webpages, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return wrap


@query("op3_quality_crf")
def _quality(spark, folder):
    return quality.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_simhash")
def _simhash(spark, folder):
    return simhash.edit_report(table(spark, folder, "documents"))


@query("op8_toxicity_compression")
def _toxicity(spark, folder):
    return toxicity.toxicity_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_language_mixture")
def _language(spark, folder):
    return language.language_report(table(spark, folder, "documents"))


@query("op4_packing_tiers")
def _packing(spark, folder):
    docs = table(spark, folder, "documents")
    packed = packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=public_tokenizers.path("byte_bpe_50k.json")
    )
    return packed


@query("op6_bpe_duckdb")
def _bpe(spark, folder):
    docs = table(spark, folder, "documents")
    return bpe.code_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query(
    "op5_warc_zip",
    """WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
last AS (SELECT hex, max(page_id) AS last_id FROM p GROUP BY hex)
SELECT page_id, octet_length(payload) AS payload_bytes,
    -- five hexadecimal digits are four base32 ones
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM p JOIN last USING (hex)""",
)
def _warc(spark, folder):
    return warc.archive_round_trip(table(spark, folder, "pages"))


@query("op2_secret_entropy")
def _secrets(spark, folder):
    return secrets.secret_report(table(spark, folder, "documents"))


@query(
    "op10_minhash_forest",
    """WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
    SELECT a, b FROM both_have JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * common >= 85 * (na.size + nb.size - common)),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT a AS doc_id, coalesce(any_value(size), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept
FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a""",
)
def _minhash(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


@query(
    "op1_subspace_pigeonhole",
    """WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM link l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id""",
)
def _embeddings(spark, folder):
    return embeddings.near_vectors(table(spark, folder, "embeddings"), 0.98)


@query("op11_shifted_cholesky")
def _whitening(spark, folder):
    return whitening.whiten_vectors(table(spark, folder, "embeddings"))


@query(
    "op12_sorted_spelling",
    """WITH RECURSIVE runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS bytes FROM runs WHERE length(run) >= 7 GROUP BY doc, run),
hashed AS (
    -- the checksum's remainder takes in one bit after the other, the lowest of each byte first
    SELECT run, n, xor(list_reduce(list_transform(range(0, 4 * length(bytes)),
        lambda k: (('0x' || substr(bytes, 1 + 2 * (k // 8)::INT, 2))::BIGINT >> (k % 8)::INT) & 1),
        lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM counted),
damaged AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n AS times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
holes AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM words),
near AS (
    SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT w.word, h.word, h.n FROM words w JOIN holes h ON h.rest = w.word
    UNION SELECT h.word, w.word, w.n FROM words w JOIN holes h ON h.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other FROM near GROUP BY word),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN other END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM walk JOIN formed f ON f.word = walk.word
WHERE walk.root IN (SELECT word FROM formed WHERE form IS NULL)""",
)
def _spelling(spark, folder):
    return spelling.spelling_groups(table(spark, folder, "documents"))


@query(
    "op13_site_style_tree",
    # the pages of the given tables hold one article element each, with headings, paragraphs, line breaks and bold text
    """SELECT page_id, url, text, length(text) AS n_chars FROM (
    SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages)""",
)
def _webpages(spark, folder):
    return webpages.extract_pages(table(spark, folder, "pages"))


@query("pipeline")
def _pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
