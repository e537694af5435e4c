"""Readers with explicit schemas; nothing infers types by scanning the data."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.runtime import new_path, stage

#: Shape of every curated list after standardisation.
LIST_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("oncogene", T.BooleanType()),
        T.StructField("tsg", T.BooleanType()),
    ]
)


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = "\t"
) -> DataFrame:
    """Table with a header line."""
    return spark.read.schema(schema).csv(path, sep=sep, header=True)


def read_banner_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, header: Sequence[str]
) -> DataFrame:
    """CSV whose second line is the header: the banner is skipped as the first line of each file,
    the header line as the row that repeats the header names."""
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, mode="PERMISSIVE")
    is_header = F.lit(True)
    for column, name in zip(rows.columns, header):
        if rows.schema[column].dataType == T.StringType():
            is_header = is_header & F.coalesce(F.col(column) == F.lit(name), F.lit(False))
    return rows.filter(~is_header)


def read_name_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless list with one name per line."""
    return spark.read.schema("symbol STRING").csv(path, header=False)


def read_positional(
    spark: SparkSession, path: str | list[str], n_columns: int, header: Sequence[str] | None = None
) -> DataFrame:
    """Headerless table addressed by position (``c0``, ``c1``, ...).

    With ``header`` (the texts of a header line) lines that equal it are left out, wherever a file has
    them; every other line is a row, whatever its key looks like.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n_columns)])
    lines = spark.read.schema("value STRING").text(path)
    if header is not None:
        lines = lines.filter(F.col("value") != F.lit("\t".join(header)))
    parts = F.split("value", "\t")
    return lines.select(*[F.get(parts, F.lit(i)).alias(f.name) for i, f in enumerate(schema)])


def read_quoted(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """Space-separated, quoted table; quotes are removed from header and values."""
    schema = T.StructType([T.StructField(c.replace('"', ""), T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, sep=" ", quote='"', header=True)
    return rows.select(*[F.replace(F.col(c), F.lit('"'), F.lit("")).alias(c) for c in rows.columns])


def read_pruned(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    columns: Sequence[str],
    sep: str = "\t",
) -> DataFrame:
    """Only the named columns; the pruning reaches the scan."""
    return read_delimited(spark, path, schema, sep).select(*columns)


def read_or_empty(read, spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Result of ``read()``, or an empty table with ``schema`` when the source does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail while planning when a column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present are {df.columns}")
    return df


def normalize_key_column(
    df: DataFrame, key: str = "key", saved_index: Sequence[str] = ("Unnamed: 0", "_c0")
) -> DataFrame:
    """Drop a saved index column; name the first column ``key``.

    When the unnamed first column is the only non-numeric one it *is* the key and is renamed.
    """
    first = df.columns[0]
    if first in saved_index and isinstance(df.schema[first].dataType, T.NumericType):
        df = df.drop(first)
        first = df.columns[0]
    return df.withColumnRenamed(first, key)


def read_network_json(
    spark: SparkSession, path: str | list[str], multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, name)`` and edges ``(src_id, dst_id)`` of a network container.

    A container is a list of aspects, some with ``nodes`` and some with ``edges``.  It may be one JSON text of any size and
    layout, or (``multi_line=False``) hold one aspect per line.  Both are read in parallel splits.
    """
    if multi_line:
        elements = aspect_elements(spark, path)
        node = F.from_json("element", "`@id` BIGINT, n STRING")
        edge = F.from_json("element", "s BIGINT, t BIGINT")
        nodes = elements.filter("aspect = 'nodes'").select(node.alias("x")).select(F.col("x.`@id`").alias("id"), F.col("x.n").alias("name"))
        edges = elements.filter("aspect = 'edges'").select(edge.alias("x")).select(F.col("x.s").alias("src_id"), F.col("x.t").alias("dst_id"))
        return nodes, edges
    schema = (
        "nodes ARRAY<STRUCT<`@id`: BIGINT, n: STRING, r: STRING>>, "
        "edges ARRAY<STRUCT<`@id`: BIGINT, s: BIGINT, t: BIGINT>>"
    )
    aspects = spark.read.schema(schema).json(path)
    nodes = aspects.filter("nodes IS NOT NULL").select(F.explode("nodes").alias("x")).select(
        F.col("x.`@id`").alias("id"), F.col("x.n").alias("name")
    )
    edges = aspects.filter("edges IS NOT NULL").select(F.explode("edges").alias("x")).select(
        F.col("x.s").alias("src_id"), F.col("x.t").alias("dst_id")
    )
    return nodes, edges


def _pieces(values: pa.Array, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of text that end before a closing brace: whether each ends inside a string, and what it adds to the depth; ``inside`` is how the first begins."""
    # an escape is never cut in two, as no brace is escaped
    bare = pc.replace_substring_regex(values, r"\\.", "")
    quotes = pc.count_substring(bare, '"').to_numpy()
    after = (quotes.cumsum() + inside) % 2 == 1
    before = np.append(inside, after[:-1])
    whole = pc.binary_join_element_wise(pa.array(np.where(before, '"', "")), bare, pa.array(np.where(after, '"', "}")), "")
    outside = pc.replace_substring_regex(whole, '"[^"]*"', "")
    up, down = (sum(pc.count_substring(outside, c).to_numpy().astype(np.int64) for c in chars) for chars in ("[{", "]}"))
    return after, up - down


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The pieces of each batch by the file and the split that they are read from, both in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column("start").to_numpy()
        # two files of one task may begin at the same place
        file = batch.column("file").dictionary_encode()
        number = file.indices.to_numpy()
        cuts = np.flatnonzero((start[1:] != start[:-1]) | (number[1:] != number[:-1])) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)]):
            yield (file.dictionary[int(number[x])].as_py(), int(start[x])), batch.column("value").slice(x, y - x)


def _split_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: whether its quotes are odd, and what it adds to the depth if it begins outside, or inside, a string."""
    sums: dict[tuple[str, int], list] = {}
    for key, values in _splits(batches):
        now = sums.setdefault(key, [False, True, 0, 0])
        for h in (0, 1):
            after, step = _pieces(values, now[h])
            now[h], now[2 + h] = bool(after[-1]), now[2 + h] + int(step.sum())
    for (file, start), (odd, _, outside, inside) in sums.items():
        row = [pa.array([file], pa.string()), pa.array([start], pa.int64()), pa.array([odd], pa.bool_()), pa.array([outside], pa.int64()), pa.array([inside], pa.int64())]
        yield pa.RecordBatch.from_arrays(row, names=["file", "start", "odd", "outside", "inside"])


SPLIT_SUMS = "file string, start bigint, odd boolean, outside bigint, inside bigint"
#: Depth of the objects' list of an aspect.
LIST_DEPTH = 3
HEADING = r'"([^"\\]+)"\s*:\s*\[\s*(?=\{)'


def aspect_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, aspect, element)``: every object of every aspect of ``[{"aspect": [{...}, ...]}, ...]`` as JSON text.

    The text is cut at every closing brace by Spark's reader, so one file is read by many tasks at byte ranges.  What a piece means depends on
    all text before it: an odd number of quotes says that it begins inside a string, and the brackets outside strings give its depth.  A first pass
    sums both for every split, one small row each; a second one begins each split with the totals of those before it.  Pieces up to a return to
    the depth of an aspect's list make up one element, so elements may nest objects and strings may hold braces.  Only the text at the ends of a split,
    which may go on in the next, is shuffled.  Empty aspects and other values of an aspect yield no rows; names of aspects hold no escapes.
    """
    # both passes need the same splits, whatever executors come or go between them
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if session.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set("spark.sql.files.minPartitionNum", max(1, spark.sparkContext.defaultParallelism))
    read = session.read.option("lineSep", "}").text(path)
    pieces = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    last, inside, depth = None, False, 0
    # one small row per split
    for r in sorted(pieces.mapInArrow(_split_sums, SPLIT_SUMS).collect(), key=lambda r: (r.file, r.start)):
        if r.file != last:
            last, inside, depth = r.file, False, 0
        begins[(r.file, r.start)] = (inside, depth)
        depth += r.inside if inside else r.outside
        inside ^= r.odd
    known = spark.sparkContext.broadcast(begins)
    # part 0 ends an element begun before its split, or lies in its midst; 1: whole elements; 2: what begins an element at the split's end; 3: the last heading
    schema = "file string, start bigint, part int, closed boolean, text string, before bigint, after bigint, aspect string"

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, aspect, open_text = None, 0, None, []
        inside, depth, first = False, 0, 0

        def rows(part: int, closed: bool, texts: list, before: list, after: list, aspects: list) -> pa.RecordBatch:
            n = len(texts)
            columns = [
                pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([closed] * n, pa.bool_()),
                pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(aspects, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["file", "start", "part", "closed", "text", "before", "after", "aspect"])

        def end() -> Iterator[pa.RecordBatch]:
            if open_text:
                yield rows(0 if part == 0 else 2, False, ["}".join(open_text) + "}"], [first], [depth], [None])
            if aspect is not None:
                yield rows(3, False, [""], [depth], [depth], [aspect])

        for now, values in _splits(batches):
            if now != key:
                yield from end()
                key, part, aspect, open_text = now, 0, None, []
                inside, depth = known.value[key]
                first = depth
            after, step = _pieces(values, inside)
            level = depth + step.cumsum()
            texts, at = values.to_pylist(), 0
            found, before, aspects = [], [], []
            ends = np.flatnonzero(~after & (level <= LIST_DEPTH))
            for e, reached in zip(ends.tolist(), level[ends].tolist()):
                text = "}".join([*open_text, *texts[at : e + 1]]) + "}"
                if part == 0:
                    yield rows(0, True, [text], [first], [reached], [None])
                    part = 1
                elif reached == LIST_DEPTH:
                    # a heading lies between the end of one list and the first element of the next
                    if first < LIST_DEPTH or text.lstrip(" \t\n\x0b\f\r").startswith("]"):
                        heading = re.search(HEADING, text, re.ASCII)
                        aspect = heading.group(1) if heading else ""
                    found.append(text)
                    before.append(first)
                    aspects.append(aspect)
                at, first, open_text = e + 1, reached, []
            open_text += texts[at:]
            inside, depth = bool(after[-1]), int(level[-1])
            if found:
                yield rows(1, True, found, before, [LIST_DEPTH] * len(found), aspects)
        if key is not None:
            yield from end()

    written = new_path(spark, "elements")
    pieces.mapInArrow(elements, schema).write.parquet(written)
    known.unpersist()
    found = spark.read.schema(schema).parquet(written)
    # one or two rows of every split: the elements that end in a split as its first ones, with the aspects that they and the next ones belong to
    closed = F.col("closed").cast("bigint")
    number = F.sum(closed).over(Window.partitionBy("file").orderBy("start", "part")) - closed
    ends = found.filter("part IN (0, 2)").withColumn("number", number)
    at = F.struct("start", "part")
    over = ends.groupBy("file", "number").agg(
        F.max("start").alias("start"),
        F.when(F.bool_or("closed"), 0).otherwise(2).alias("part"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part", "text"))), lambda p: p["text"]), "").alias("text"),
        # the depth before the first piece and after the last one
        F.min_by("before", at).alias("before"),
        F.max_by("after", at).alias("after"),
    )
    heads = (F.col("before") < LIST_DEPTH) | F.col("text").rlike(r"^\s*\]")
    name = F.when((F.col("after") == LIST_DEPTH) & heads, F.regexp_extract("text", "(?s)" + HEADING, 1))
    columns = ["file", "start", "part", "text", "before", "after", "aspect"]
    told = over.withColumn("aspect", name).select(*columns).unionByName(found.filter("part = 3").select(*columns))
    so_far = F.last("aspect", ignorenulls=True).over(Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = stage(told.withColumn("aspect", so_far).filter("part <> 3"), "ends")
    begun = told.filter("part = 0").select("file", "start", F.col("aspect").alias("begun"))
    whole = found.filter("part = 1").join(begun, ["file", "start"], "left").withColumn("aspect", F.coalesce("aspect", "begun")).select(*columns)
    every = whole.unionByName(told.filter(F.col("after") == LIST_DEPTH)).filter("aspect IS NOT NULL")
    body = F.when(heads, F.regexp_replace("text", "(?s)^.*?" + HEADING, "")).otherwise(F.regexp_replace("text", r"^[\s,]*", ""))
    return every.select("file", "aspect", body.alias("element"))


def _folder_name(part: Column) -> Column:
    """Folder name, also of a ``column=value`` partition folder."""
    return F.regexp_replace(F.url_decode(part), r"^\w+=", "")


def read_reports(spark: SparkSession, path: str, file_name: str | None = None) -> DataFrame:
    """Whole text reports below ``path``: ``(file_path, run, model, content)``.

    Run and model are the two folders above the file.
    """
    files = spark.read.text(
        path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=file_name
    ).select("value", F.col("_metadata.file_path").alias("file_path"))
    parts = F.split("file_path", "/")
    return files.select(
        "file_path",
        _folder_name(F.try_element_at(parts, F.lit(-3))).alias("run"),
        _folder_name(F.try_element_at(parts, F.lit(-2))).alias("model"),
        F.col("value").alias("content"),
    )


#: Spellings of a model folder and the name they stand for.
MODEL_ALIASES = {
    "support_vector_classifier": "svc",
    "k-nearest_neighbors": "k_nearest_neighbors",
    "multi-layer_perceptron": "multi_layer_perceptron",
    "hist_gradient_boosting": "histogram_gradient_boosting",
}

#: Prediction file names, best first.
PREDICTION_FILES = ("predictions.json", "default_metrics.json", "metrics.json", "results.json")

_PREDICTION_STRUCT = "STRUCT<y_true: ARRAY<INT>, y_pred: ARRAY<INT>, y_pred_proba: ARRAY<ARRAY<DOUBLE>>>"


#: An older layout keeps one file per model in the run's own folder; the model is in the file name.
ROOT_FILE = r"(?i)^nested_cv_(.+?)(?:_\d[^/]*)?\.json$"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One row per predicted example: ``(run, model, position, y_true, y_pred, proba)``.

    Of several prediction file names in one model folder the best one is used, with all files of the
    same rank; ``position`` counts within a file.  Model folders with a variant spelling are unified.  Files
    ``nested_cv_<model>...json`` in a run's own folder are used for models without a folder.  Part
    files hold one record per line, either a document or one example as ``write_predictions_json`` writes it.
    """
    from labelweave.operators.ordering import join_null_safe

    schema = f"test_predictions {_PREDICTION_STRUCT}, predictions {_PREDICTION_STRUCT}"
    example = "position INT, y_true INT, y_pred INT, proba ARRAY<DOUBLE>"
    whole = (
        spark.read.option("recursiveFileLookup", True)
        .schema(schema)
        .json(path, multiLine=True, pathGlobFilter="*.json")
        .filter(~F.col("_metadata.file_name").startswith("part-"))
    )
    lines = spark.read.option("recursiveFileLookup", True).schema(f"{schema}, {example}").json(path, pathGlobFilter="part-*.json")
    files = whole.select("*", F.col("_metadata.file_path").alias("file_path")).unionByName(
        lines.select("*", F.col("_metadata.file_path").alias("file_path")), allowMissingColumns=True
    )
    parts = F.split("file_path", "/")
    aliases = F.create_map(*[F.lit(x) for pair in MODEL_ALIASES.items() for x in pair])
    name = F.url_decode(F.element_at(parts, -1))
    at_root = name.rlike(ROOT_FILE)
    folder = F.lower(F.when(at_root, F.regexp_extract(name, ROOT_FILE, 1)).otherwise(_folder_name(F.element_at(parts, -2))))
    priority = F.array_position(F.array(*[F.lit(f) for f in PREDICTION_FILES]), name)
    last = F.lit(len(PREDICTION_FILES) + 1)
    tagged = files.select(
        F.when(at_root, _folder_name(F.element_at(parts, -2))).otherwise(_folder_name(F.element_at(parts, -3))).alias("run"),
        F.coalesce(F.try_element_at(aliases, folder), folder).alias("model"),
        F.when(priority > 0, priority).when(at_root, last + 1).otherwise(last).alias("priority"),
        F.coalesce("test_predictions", "predictions").alias("p"),
        F.struct("position", "y_true", "y_pred", F.col("proba").alias("y_pred_proba")).alias("one"),
    ).filter("p IS NOT NULL OR coalesce(one.y_true, one.y_pred) IS NOT NULL OR one.y_pred_proba IS NOT NULL")
    # the files are opened and parsed once
    tagged = stage(tagged, "tagged")
    best = tagged.groupBy("run", "model").agg(F.min("priority").alias("priority"))
    # all files of the best name: a folder may hold one file per fold or task
    chosen = join_null_safe(tagged, best, ["run", "model", "priority"])
    zipped = F.transform(
        F.arrays_zip("p.y_true", "p.y_pred", "p.y_pred_proba"),
        lambda e, i: F.struct(i.alias("position"), e["y_true"].alias("y_true"), e["y_pred"].alias("y_pred"), e["y_pred_proba"].alias("y_pred_proba")),
    )
    examples = F.when(F.col("p").isNotNull(), zipped).otherwise(F.array("one"))
    return chosen.select("run", "model", F.explode(examples).alias("e")).select(
        "run",
        "model",
        F.col("e.position").alias("position"),
        F.col("e.y_true").alias("y_true"),
        F.col("e.y_pred").alias("y_pred"),
        F.col("e.y_pred_proba").alias("proba"),
    )
