"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables find near ones.

Terms are pairs of adjacent words (a text of one word has that word); a term weighs one plus the logarithm of its number of
occurrences.  A fingerprint is 128 bits as 32 hexadecimal digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.common import Remembered, map_texts
from labelweave.runtime import stage

BITS = 128
#: Bytes of words and hashes that a task remembers.
CACHE_BYTES = 24 << 20
#: bit i of byte value v as +1 or -1
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1)


class WordHashes(Remembered):
    """Word -> 64-bit hash; forgets everything when it is full."""

    def __init__(self):
        super().__init__(CACHE_BYTES)

    def __missing__(self, word: str) -> int:
        digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return self.keep(word, int.from_bytes(digest, "little"), len(word))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str, hashes: WordHashes) -> bytes:
    """16 bytes; a text without words has all bits zero."""
    words = text.split()
    if not words:
        return bytes(BITS // 8)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    terms = h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:] if len(h) > 1 else h
    terms = np.sort(terms)
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    tf = np.diff(np.append(first, len(terms)))
    unique = terms[first]
    weight = 1.0 + np.log(tf)
    two = np.stack([_mix(unique), _mix(unique ^ np.uint64(0xD6E8FEB86659FD93))], 1).astype("<u8")
    octets = two.view(np.uint8)
    votes = np.empty((BITS // 8, 8))
    for k in range(BITS // 8):
        votes[k] = np.bincount(octets[:, k], weights=weight, minlength=256) @ _SIGNS
    # rounded, so that the order of the sums never decides a bit
    return np.packbits(np.round(votes.ravel(), 6) > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """One minus the share of differing bits."""
    return 1.0 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``fingerprint`` of every whole text (null counts as empty)."""

    def make():
        hashes = WordHashes()
        return lambda texts: {"fingerprint": [fingerprint(t, hashes).hex() for t in texts]}

    return map_texts(docs, make, "fingerprint string", keep)


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int = 5, column: str = "fingerprint") -> DataFrame:
    """All pairs ``(a, b, distance)`` of different fingerprints, a < b, within ``radius`` bits.

    Equal fingerprints are one row first.  The bits are cut into ``blocks`` blocks; a pair within the radius
    agrees on ``blocks - radius`` of them, so each choice of that many blocks is one permuted table keyed by
    their bits, and a pair is reported by its first table only.  Rows of a key that share a table are joined by
    Spark, which splits a hot key; the number of tables is a parameter, not the data's.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")
    bits = F.col(column)
    n_hex = BITS // 4
    cuts = [round(i * n_hex / blocks) for i in range(blocks + 1)]
    parts = [F.substring(bits, cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(blocks)]
    choices = list(combinations(range(blocks), blocks - radius))
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.concat_ws("|", *[parts[i] for i in c]).alias("key")) for t, c in enumerate(choices)])
    # staged, as both sides of the join read it
    rows = stage(prints.filter(bits.isNotNull()).select(bits.alias("f")).distinct(), "prints")
    tables = rows.withColumnRenamed("f", column).select(F.col(column).alias("f"), F.explode(keys).alias("t")).select("f", "t.*")
    left, right = tables.withColumnRenamed("f", "a"), tables.withColumnRenamed("f", "b")
    words = [
        F.bit_count(
            F.conv(F.substring(F.col("a"), 1 + 15 * i, 15), 16, 10).cast("bigint").bitwiseXOR(
                F.conv(F.substring(F.col("b"), 1 + 15 * i, 15), 16, 10).cast("bigint")
            )
        )
        for i in range(-(-n_hex // 15))
    ]
    # a pair is met in every table whose blocks all agree; the first one reports it
    equal = [F.substring("a", cuts[i] + 1, cuts[i + 1] - cuts[i]) == F.substring("b", cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(blocks)]
    first = F.coalesce(*[F.when(_all([equal[i] for i in c]), F.lit(t)) for t, c in enumerate(choices)])
    return (
        left.join(right, ["table", "key"])
        .filter("a < b")
        .withColumn("distance", sum(words[1:], words[0]).cast("int"))
        .filter((F.col("distance") <= radius) & (first == F.col("table")))
        .select("a", "b", "distance")
    )


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_EDIT_COLUMNS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT = _EDIT_COLUMNS + ", edge string, part int, text string"


def _edit_row(doc_id, text, own, following, next_print, hashes) -> tuple:
    other = edited(text, following)
    print_ = own if other == text else fingerprint(other, hashes)
    return (
        doc_id,
        len(text),
        hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
        own.hex(),
        print_.hex(),
        likeness(own, print_),
        likeness(own, next_print),
    )


def edit_report(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (see :func:`edited`).

    Documents follow each other by descending ``doc_id`` (null ids last, ties by a hash of the text) and the last is followed
    by the first.  One range partitioning puts neighbours together; a partition's last row meets the next
    partition's first row in a join of one such row for each partition, so no global order goes through one task.  A lone
    document follows itself.  Null texts count as empty; repeated ids keep a row each.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the hash and not the text breaks ties: the range bounds are sampled to the driver
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = source.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        hashes = WordHashes()
        held = None
        names = [c.split()[0] for c in _OUT.split(", ")]
        types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _OUT.split(", ")])

        def table(rows):
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                some = batch.slice(at, 256)
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    own = fingerprint(text, hashes)
                    if held is None:
                        out.append((doc_id, len(text), None, own.hex(), None, None, None, "first", part, text))
                    else:
                        out.append((*_edit_row(*held, text, own, hashes), None, part, None))
                    held = (doc_id, text, own)
                yield table(out)
        if held is not None:
            doc_id, text, own = held
            yield table([(doc_id, len(text), None, own.hex(), None, None, None, "last", part, text)])

    rows = stage(dealt.mapInArrow(run, _OUT), "edits")
    # one row for each partition that has rows: its first and last row, and the partition that follows it
    firsts = rows.filter("edge = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    lasts = rows.filter("edge = 'last'").select("part", "doc_id", "text", "fingerprint")
    parts = firsts.select("part")
    follow = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("following"), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("_first"))
    follow = follow.select("part", F.coalesce("following", "_first").alias("following"))
    pairs = lasts.join(follow, "part").join(firsts.withColumnRenamed("part", "following"), "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = [
                _edit_row(r["doc_id"], r["text"], bytes.fromhex(r["fingerprint"]), r["next_text"], bytes.fromhex(r["next_print"]), hashes)
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], pa.int64() if i < 2 else pa.string() if i < 5 else pa.float64()) for i in range(7)],
                names=[c.split()[0] for c in _EDIT_COLUMNS.split(", ")],
            )

    columns = [c.split()[0] for c in _EDIT_COLUMNS.split(", ")]
    return rows.filter("edge IS NULL").select(*columns).unionByName(pairs.select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(finish, _EDIT_COLUMNS))
