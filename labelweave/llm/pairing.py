"""Comparing the rows that share a key, however many they are, in tasks of bounded size.

A key's rows are cut into chunks; every two chunks (and each chunk with itself) are one task group.  Groups
are laid out by Spark as runs of sorted rows, and each run is handed to a function as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelweave.llm.common import releasing

#: Rows of a chunk.
CHUNK = 256


def deal_chunks(rows: DataFrame, key: list[str], order, counts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``chunk`` (int) and ``chunks``: rows of one key with about ``chunk`` rows each.

    ``counts`` has the keys with more than ``chunk`` rows and their ``n``; all other keys are one chunk.  ``order`` is a
    long column: rows that have it in common stay together unless there are too many of them.
    """
    large = counts.filter(F.col("n") > chunk).select(*key, F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    joined = rows.join(large, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return joined.withColumn("chunk", F.pmod(order, F.col("chunks")).cast("int"))


def deal_pairs(dealt: DataFrame) -> DataFrame:
    """One row per chunk pair ``(i, j)``, ``i <= j``, that a row belongs to, with ``side`` 0 (in ``i``) or 1 (in ``j``).

    In the pair of a chunk with itself rows are on side 0.
    """
    own = F.col("chunk")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda c: F.struct(
            F.least(own, c).alias("i"), F.greatest(own, c).alias("j"), F.when(c < own, 1).otherwise(0).alias("side")
        ),
    )
    return dealt.withColumn("_pair", F.explode(pairs)).select("*", "_pair.i", "_pair.j", "_pair.side").drop("_pair", "chunk", "chunks")


def map_groups(
    rows: DataFrame, keys: list[str], function: Callable[[pa.Table], pa.Table | pa.RecordBatch | None], schema: str, partitions: int | None = None
) -> DataFrame:
    """Apply ``function`` to the rows of every group of ``keys`` (not null), one group in memory at a time.

    Groups are dealt by the hash of their keys and sorted inside a task, so a task streams through its groups.
    """
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        held_key = None

        def close():
            table = function(pa.Table.from_batches(held))
            if table is not None and table.num_rows:
                table = table.select(out.names).cast(out)
                yield from table.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            starts = np.append(np.flatnonzero(change), batch.num_rows)
            for a, b in zip(starts[:-1], starts[1:]):
                key = tuple(c[a] for c in columns)
                if held and key != held_key:
                    yield from close()
                    held = []
                held_key = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    dealt = rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(releasing(run), schema)


class Groups:
    """Union-find over the rows of one task group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
