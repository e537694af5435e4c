"""What the corpus operators share: folds, bounded label samples, Arrow batches of texts, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelweave.runtime import stage

#: Documents, and bytes of text, that one call of a batch function sees at most; one text is never cut here.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 20
#: What an entry of a cache takes besides its key's and value's bytes.
ENTRY_BYTES = 160


class Remembered(dict):
    """Values by key for a task, of at most about ``budget`` bytes: it forgets everything when it is full.

    Subclasses compute a missing value and give it to :meth:`keep`.
    """

    def __init__(self, budget: int):
        super().__init__()
        self.budget, self.used = budget, 0

    def keep(self, key, value, size: int):
        size += ENTRY_BYTES
        if size <= self.budget >> 3:
            if self.used + size > self.budget:
                self.clear()
                self.used = 0
            self.used += size
            self[key] = value
        return value


def release_memory() -> None:
    """Hand free memory back to the system: a worker lives on, and the next task would start on top of this one's peak."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # another C library, which needs no such call
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task, after which memory is handed back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped


def small_batches(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes of text, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(at + BATCH_ROWS, max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right"))))
        yield batch.slice(at, end - at)
        at = end


def fold(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """``crc32(doc_id as text) mod folds``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return fold(doc_id) == 0


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    columns: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    nulls: bool = False,
) -> DataFrame:
    """Add ``columns`` (DDL) computed from batches of whole texts to the ``keep`` columns.

    ``make`` runs once per task and returns the batch function, which gets a list of texts (null texts
    as empty ones, or as None with ``nulls``) and returns one list per new column.  Other columns of
    ``docs`` are pruned from the scan.
    """
    # kept columns may have any name, so all are read by their place
    source = docs.select(*keep, F.col(text)).toDF(*[f"c{i}" for i in range(len(keep))], "_text")
    added = T._parse_datatype_string(columns)
    schema = T.StructType([*docs.select(*keep).schema.fields, *added.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in small_batches(batch, "_text"):
                texts = part.column("_text").to_pylist()
                out = function(texts if nulls else [t or "" for t in texts])
                arrays = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                arrays += [pa.array(out[f.name], arrow.field(len(keep) + i).type) for i, f in enumerate(added.fields)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(releasing(run), schema)


def filter_texts(
    docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the batch function of ``make`` accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in small_batches(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                yield part.filter(pa.array(function(texts), pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Texts with a label for fitting: ``doc_id, text, label`` of documents outside the held-out fold.

    At most ``per_class`` ids per label value are chosen, in the order of a hash of the id, so the sample is
    the same for any partitioning.  A label that is null, or an id labelled both ways, is left out.  The
    chosen ids are at most ``2 * per_class`` rows, which is the proven bound of the broadcast.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .filter("label = _most")
        .select("doc_id", "label")
    )
    ids = [
        known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for value in (0, 1)
    ]
    chosen = F.broadcast(stage(ids[0].unionByName(ids[1]), "label_ids"))
    return docs.select("doc_id", "text").join(chosen, "doc_id")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest member of each vertex's component: ``(vertex, component)`` for every vertex of ``links``.

    Alternating large-star and small-star steps over a staged edge table.  Each round groups by the larger
    endpoint only for a minimum (aggregated per task first) and joins it back, so a vertex with very many
    links is never collected; the number of rounds grows with the logarithm of the component size.  The rounds end
    when every vertex has at most one smaller neighbour, and larger ones only if it has none.
    """
    both = lambda df: df.select("u", "v").union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # repeated links are dropped by the first small star
    edges = stage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v"), "links")
    for _ in range(max_rounds):
        smaller = F.when(F.col("v") < F.col("u"), F.col("v"))
        least = both(edges).groupBy("u").agg(
            F.least("u", F.min("v")).alias("m"), F.max(smaller).alias("most"), F.max(F.col("v") > F.col("u")).alias("parent")
        )
        least = stage(least, "least")
        if least.filter("most > m OR (parent AND m < u)").isEmpty():
            break
        # large star: a vertex's larger neighbours point to the least of the vertex and its neighbours
        large = both(edges).filter("v > u").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(large, "large_star")
        # small star: a vertex and its smaller neighbours point to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        others = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(others.union(least.select("u", F.col("m").alias("v"))).distinct(), "small_star")
    else:
        raise RuntimeError("components did not settle")
    return least.select(F.col("u").alias("vertex"), F.col("m").alias("component"))
