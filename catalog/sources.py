"""Readers, writers, cleaning and projection queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog.base import (
    DICTIONARY,
    FOLDS,
    LIST_A,
    LIST_B,
    LIST_C,
    LIST_INPUTS,
    PATHWAYS,
    list_sql,
    name_of,
    plain,
    query,
    rounded,
    rows,
    table,
    with_inputs,
)
from labelweave.functions.text import display_name, slug
from labelweave.operators import clean, metrics
from labelweave.operators.dedupe import concat_sources
from labelweave.operators.synonyms import build_synonym_map
from labelweave.runtime import new_path
from labelweave.sources import readers, writers

CUSTOMERS = "SELECT c_name AS symbol, c_acctbal AS balance, c_nationkey AS nation FROM {customer}"
FLAGGED_NAMES = "SELECT c_name AS symbol, c_acctbal > 7000 AS oncogene, c_acctbal < 500 AS tsg FROM {customer}"


def _tsv(spark, folder):
    path = new_path(spark, "tsv")
    writers.write_tsv(rows(spark, folder, CUSTOMERS), path)
    return path


@query("read_tsv", plain(CUSTOMERS))
def read_tsv(spark, folder):
    return readers.read_delimited(spark, _tsv(spark, folder), "symbol STRING, balance DOUBLE, nation INT")


@query("read_pruned", "SELECT c_name AS symbol, c_nationkey AS nation FROM customer")
def read_pruned(spark, folder):
    schema = "symbol STRING, balance DOUBLE, nation INT"
    return readers.read_pruned(spark, _tsv(spark, folder), schema, ["symbol", "nation"])


def _with_banner(batches):
    first = True
    for batch in batches:
        lines = (batch["input"] + "," + batch["match_type"] + "," + batch["approved"].fillna("")).tolist()
        if first:
            lines = ["Checked symbols of one session", "Input,Match type,Approved symbol", *lines]
            first = False
        yield pd.DataFrame({"value": lines})


@query("read_csv_skip_banner", with_inputs("SELECT input, match_type, approved FROM dict", dict=DICTIONARY))
def read_csv_skip_banner(spark, folder):
    path = new_path(spark, "banner")
    rows(spark, folder, DICTIONARY).mapInPandas(_with_banner, "value STRING").write.text(path)
    return readers.read_banner_csv(
        spark, path, "input STRING, match_type STRING, approved STRING", ["Input", "Match type", "Approved symbol"]
    )


@query("read_name_list", "SELECT c_name AS symbol FROM customer")
def read_name_list(spark, folder):
    path = new_path(spark, "names")
    table(spark, folder, "customer").select("c_name").write.text(path)
    return readers.read_name_list(spark, path)


@query("read_headerless_multi", "SELECT CAST(p_partkey AS VARCHAR) AS c0, p_type AS c1, p_name AS c2 FROM part")
def read_headerless_multi(spark, folder):
    path = new_path(spark, "positional")
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_no"), F.col("p_type").alias("symbol_1"), F.col("p_name").alias("synonyms_1")
    )
    part.write.csv(path, sep="\t", header=True)
    return readers.read_positional(spark, path, 3, header=["row_no", "symbol_1", "synonyms_1"])


@query("read_quoted_space", "SELECT c_name AS SYMBOL, c_mktsegment AS SEGMENT FROM customer")
def read_quoted_space(spark, folder):
    path = new_path(spark, "quoted")
    quoted = table(spark, folder, "customer").select(F.col("c_name").alias("SYMBOL"), F.col("c_mktsegment").alias("SEGMENT"))
    quoted.write.csv(path, sep=" ", quote='"', quoteAll=True, header=True)
    return readers.read_quoted(spark, path, ['"SYMBOL"', '"SEGMENT"'])


@query(
    "normalize_key_column",
    "SELECT c_name AS key, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier",
)
def normalize_key_column(spark, folder):
    indexed = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Unnamed: 0"), F.col("c_name").alias("gene"), F.col("c_acctbal").alias("balance")
    )
    unnamed = table(spark, folder, "supplier").select(
        F.col("s_name").alias("Unnamed: 0"), F.col("s_acctbal").alias("balance")
    )
    return readers.normalize_key_column(indexed).unionByName(readers.normalize_key_column(unnamed))


NETWORK_ROWS = """SELECT 'edge' AS kind, l_partkey AS id, l_suppkey AS other_id, NULL AS name FROM lineitem
    UNION ALL SELECT 'node', p_partkey, NULL, p_name FROM part"""


def network_aspects(spark, folder):
    """Node and edge aspects of about 5,000 elements each."""
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    edge = F.struct(F.col("l_orderkey").alias("@id"), F.col("l_partkey").alias("s"), F.col("l_suppkey").alias("t"))
    chunks = max(1, lines.count() // 5000)
    chunk = F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), F.lit(chunks))
    edges = lines.groupBy(chunk.alias("chunk")).agg(F.collect_list(edge).alias("edges")).select("edges")
    part = table(spark, folder, "part")
    node = F.struct(F.col("p_partkey").alias("@id"), F.col("p_name").alias("n"), F.lit("part").alias("r"))
    nodes = (
        part.groupBy(F.pmod(F.xxhash64("p_partkey"), F.lit(max(1, part.count() // 5000))).alias("chunk"))
        .agg(F.collect_list(node).alias("nodes"))
        .select("nodes")
    )
    return nodes, edges


def network_rows(nodes, edges):
    none = F.lit(None)
    return edges.select(F.lit("edge").alias("kind"), F.col("src_id").alias("id"), F.col("dst_id").alias("other_id"), none.cast("string").alias("name")).union(
        nodes.select(F.lit("node"), "id", none.cast("bigint"), "name")
    )


@query("read_network_json", NETWORK_ROWS)
def read_network_json(spark, folder):
    path = new_path(spark, "aspects")
    nodes, edges = network_aspects(spark, folder)
    edges.write.json(path)
    nodes.write.mode("append").json(path)
    return network_rows(*readers.read_network_json(spark, path, multi_line=False))


@query("read_network_container", NETWORK_ROWS)
def read_network_container(spark, folder):
    path = new_path(spark, "containers")
    nodes, edges = network_aspects(spark, folder)
    pretty = {"pretty": "true"}
    texts = [F.concat(F.lit('[{"status": [{"success": true}]},\n'), F.to_json(F.struct(c), pretty), F.lit("]")) for c in ("nodes", "edges")]
    nodes.select(texts[0].alias("value")).union(edges.select(texts[1].alias("value"))).write.text(path)
    return network_rows(*readers.read_network_json(spark, path))


@query("missing_source_empty", plain(FLAGGED_NAMES))
def missing_source_empty(spark, folder):
    missing = readers.read_or_empty(
        lambda: readers.read_delimited(spark, new_path(spark, "absent"), readers.LIST_SCHEMA),
        spark,
        readers.LIST_SCHEMA,
    )
    return rows(spark, folder, FLAGGED_NAMES).unionByName(missing)


@query("require_columns", "SELECT c_name, c_acctbal FROM customer")
def require_columns(spark, folder):
    return readers.require_columns(table(spark, folder, "customer"), ["c_name", "c_acctbal"]).select("c_name", "c_acctbal")


# ---------------------------------------------------------------- writers


@query(
    "write_tsv",
    with_inputs(
        "SELECT symbol, CASE WHEN oncogene THEN 'Yes' ELSE 'No' END AS oncogene, CASE WHEN tsg THEN 'Yes' ELSE 'No' END AS tsg FROM a",
        a=FLAGGED_NAMES,
    ),
)
def write_tsv(spark, folder):
    path = new_path(spark, "list")
    writers.write_tsv(rows(spark, folder, FLAGGED_NAMES), path, order=["symbol"])
    return readers.read_delimited(spark, path, "symbol STRING, oncogene STRING, tsg STRING")


LONG_FOLDS_SQL = """SELECT strategy AS run, model, fold, 'valid' AS split, metric, value FROM folds
UNPIVOT (value FOR metric IN (accuracy, prec, recall, f1, roc_auc, pr_auc))"""
LONG_FOLDS_ROUNDED = """SELECT strategy AS run, model, fold, 'valid' AS split, metric, round(value, 6) AS value FROM folds
UNPIVOT (value FOR metric IN (accuracy, prec, recall, f1, roc_auc, pr_auc))"""
MEASURES = ["accuracy", "prec", "recall", "f1", "roc_auc", "pr_auc"]


def long_folds(spark, folder):
    folds = rows(spark, folder, FOLDS).select(F.col("strategy").alias("run"), "model", "fold", F.lit("valid").alias("split"), *MEASURES)
    return metrics.long_metrics(folds, ["run", "model", "fold", "split"], MEASURES)


@query("write_metric_tables", with_inputs(LONG_FOLDS_ROUNDED, folds=FOLDS))
def write_metric_tables(spark, folder):
    path = new_path(spark, "metrics")
    writers.write_metric_tables(long_folds(spark, folder), path)
    return rounded(spark.read.parquet(path))


@query("write_model_partitions", with_inputs("SELECT model, fold, strategy, round(pr_auc, 6) AS pr_auc FROM folds", folds=FOLDS))
def write_model_partitions(spark, folder):
    path = new_path(spark, "models")
    writers.write_model_partitions(rows(spark, folder, FOLDS).select("model", "fold", "strategy", "pr_auc"), path)
    return rounded(spark.read.parquet(path))


@query(
    "write_predictions_json",
    """SELECT 'run_' || o_orderstatus AS run, 'model_' || CAST(o_custkey % 9 AS VARCHAR) AS model, o_orderkey AS key,
    CAST(o_totalprice > 250000 AS INT) AS y_true, o_totalprice / 500000 AS score FROM orders""",
)
def write_predictions_json(spark, folder):
    path = new_path(spark, "predictions")
    scored = table(spark, folder, "orders").select(
        F.concat(F.lit("run_"), "o_orderstatus").alias("run"),
        F.concat(F.lit("model_"), (F.col("o_custkey") % 9).cast("string")).alias("model"),
        F.col("o_orderkey").alias("key"),
        (F.col("o_totalprice") > 250000).cast("int").alias("y_true"),
        (F.col("o_totalprice") / 500000).alias("score"),
    )
    writers.write_predictions_json(scored, path)
    return spark.read.schema("key BIGINT, y_true INT, score DOUBLE, run STRING, model STRING").json(path)


#: prediction documents of bounded size: a thousand consecutive order numbers per document
DOCUMENTS = """SELECT 'run_' || CAST(CAST(floor(o_orderkey / 1000) AS INT) AS STRING) AS run,
CASE o_orderstatus WHEN 'F' THEN 'k-nearest_neighbors' WHEN 'O' THEN 'support_vector_classifier' ELSE 'catboost' END AS folder,
o_orderkey, CAST(o_totalprice > 250000 AS INT) AS y_true, CAST(o_totalprice > 200000 AS INT) AS y_pred,
o_totalprice / 500000 AS score FROM {orders}"""


@query(
    "read_predictions",
    with_inputs(
        """SELECT run, CASE folder WHEN 'k-nearest_neighbors' THEN 'k_nearest_neighbors'
        WHEN 'support_vector_classifier' THEN 'svc' ELSE folder END AS model,
        CAST(row_number() OVER (PARTITION BY run, folder ORDER BY o_orderkey) - 1 AS INT) AS position, y_true, y_pred, score FROM docs""",
        docs=DOCUMENTS,
    ),
)
def read_predictions(spark, folder):
    path = new_path(spark, "documents")
    documents = rows(spark, folder, DOCUMENTS)
    entry = F.struct("o_orderkey", "y_true", "y_pred", F.array(1 - F.col("score"), F.col("score")).alias("p"))
    grouped = documents.groupBy("run", F.col("folder").alias("model")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    grouped.select(
        "run",
        "model",
        F.struct(
            F.transform("e", lambda x: x["y_true"]).alias("y_true"),
            F.transform("e", lambda x: x["y_pred"]).alias("y_pred"),
            F.transform("e", lambda x: x["p"]).alias("y_pred_proba"),
        ).alias("test_predictions"),
    ).write.partitionBy("run", "model").json(path)
    read = readers.read_predictions(spark, path)
    return metrics.class_prob_column(read).drop("proba")


# ---------------------------------------------------------------- projections, filters, cleaning


@query("standardize_source", "SELECT c_name AS symbol, c_acctbal > 7000 AS oncogene, c_nationkey = 3 AS tsg FROM customer")
def standardize_source(spark, folder):
    return clean.standardize(
        table(spark, folder, "customer"), F.col("c_name"), F.col("c_acctbal") > 7000, F.col("c_nationkey") == 3
    )


#: flags with nulls
FLAGGED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
CASE WHEN l_quantity < 20 THEN NULL ELSE l_discount > 0.05 END AS oncogene,
CASE WHEN l_quantity > 40 THEN NULL ELSE l_tax > 0.04 END AS tsg FROM {lineitem}"""


@query("filter_any_flag", with_inputs("SELECT * FROM f WHERE oncogene OR tsg", f=FLAGGED))
def filter_any_flag(spark, folder):
    return clean.filter_any_flag(rows(spark, folder, FLAGGED))


@query("filter_no_flag", with_inputs("SELECT * FROM f WHERE NOT oncogene AND NOT tsg", f=FLAGGED))
def filter_no_flag(spark, folder):
    return clean.filter_no_flag(rows(spark, folder, FLAGGED))


#: numeric flags 0 / 1 / null per order
NUMERIC_FLAGS = f"""SELECT {name_of('o_custkey')} AS symbol, o_orderkey AS row_id,
CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_totalprice > 300000 THEN 1.0 ELSE 0.0 END AS a0,
CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority < '3' THEN 1.0 ELSE 0.0 END AS b0 FROM {{orders}}"""
NUMERIC = "SELECT symbol, row_id, CAST(a0 AS DOUBLE) AS a, CAST(b0 AS DOUBLE) AS b FROM (" + NUMERIC_FLAGS + ") n0"


@query(
    "numeric_flag_to_bool",
    with_inputs("SELECT symbol, row_id, coalesce(a = 1.0, false) AS a, coalesce(b = 1.0, false) AS b FROM n", n=NUMERIC),
)
def numeric_flag_to_bool(spark, folder):
    return clean.numeric_flag_to_bool(rows(spark, folder, NUMERIC), ["a", "b"])


@query(
    "numeric_flag_sum",
    with_inputs(
        """SELECT symbol, row_id, a, b, flag_sum FROM (SELECT *, a + b AS flag_sum, row_number() OVER (PARTITION BY symbol ORDER BY row_id) rn
        FROM n WHERE a + b IS NOT NULL) WHERE rn = 1""",
        n=NUMERIC,
    ),
)
def numeric_flag_sum(spark, folder):
    return clean.numeric_flag_sum(rows(spark, folder, NUMERIC), "symbol", "a", "b", ["row_id"])


#: free-text roles per document line
ROLES = """SELECT p_partkey, p_size % 3 AS tier, CASE WHEN p_brand = 'Brand#1' THEN NULL
WHEN p_type = 'PROMO' THEN 'Oncogene, fusion' WHEN p_type = 'LARGE' THEN 'TSG' WHEN p_type = 'SMALL' THEN 'oncogene, tsg' ELSE p_name END AS role FROM {part}"""


@query(
    "role_flags_from_text",
    with_inputs(
        """SELECT *, coalesce(contains(lower(role), 'oncogene'), false) AS oncogene, coalesce(contains(lower(role), 'tsg'), false) AS tsg
        FROM r WHERE tier = 1""",
        r=ROLES,
    ),
)
def role_flags_from_text(spark, folder):
    return clean.role_flags_from_text(rows(spark, folder, ROLES), "tier", 1, "role")


TEXT_FLAGS = """SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'Yes' ELSE 'No' END AS a,
CASE WHEN o_orderpriority < '3' THEN 'Yes' ELSE 'No' END AS b FROM {orders}"""


@query("combined_flag_key", with_inputs("SELECT *, a || b AS flag_key FROM t WHERE a || b <> 'NoNo'", t=TEXT_FLAGS))
def combined_flag_key(spark, folder):
    return clean.combined_flag_key(rows(spark, folder, TEXT_FLAGS), "a", "b")


@query("filter_by_type", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'")
def filter_by_type(spark, folder):
    return clean.filter_by_type(table(spark, folder, "customer"), "c_mktsegment", "BUILDING", equal=False).select("c_custkey", "c_name")


@query("filter_keyword_ci", with_inputs("SELECT * FROM pw WHERE lower(pathway) LIKE '%cancer%'", pw=PATHWAYS))
def filter_keyword_ci(spark, folder):
    return clean.filter_keyword_ci(rows(spark, folder, PATHWAYS), "pathway", "cancer")


@query("split_explode_members", with_inputs("SELECT symbol FROM members", pw=PATHWAYS, members=LIST_INPUTS["members"]))
def split_explode_members(spark, folder):
    selected = clean.filter_keyword_ci(rows(spark, folder, PATHWAYS), "pathway", "cancer")
    return clean.split_explode_members(selected, "members")


#: symbols with blanks around them, some unknown, some alphabetic
LOOSE = f"""SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN ' ' || {name_of('o_custkey')} || ' '
WHEN o_orderstatus = 'O' THEN 'Alphabetic' ELSE 'unknown_1' END AS symbol FROM {{orders}}"""


@query(
    "valid_symbol_filter",
    with_inputs(
        """SELECT row_id, CASE WHEN m.input IS NOT NULL THEN m.approved ELSE trim(s.symbol) END AS symbol
        FROM loose s LEFT JOIN map m ON trim(s.symbol) = m.input
        WHERE m.input IS NOT NULL OR regexp_full_match(trim(s.symbol), '[A-Za-z]+')""",
        dict=DICTIONARY,
        map=LIST_INPUTS["map"],
        loose=LOOSE,
    ),
)
def valid_symbol_filter(spark, folder):
    mapping = build_synonym_map(rows(spark, folder, DICTIONARY))
    return clean.valid_symbol_filter(rows(spark, folder, LOOSE), "symbol", mapping).select("row_id", "symbol")


@query("drop_null_key", with_inputs("SELECT * FROM pw WHERE pathway IS NOT NULL", pw=PATHWAYS))
def drop_null_key(spark, folder):
    return clean.drop_null_key(rows(spark, folder, PATHWAYS), "pathway")


@query("drop_any_null", with_inputs("SELECT * FROM n WHERE a IS NOT NULL AND b IS NOT NULL", n=NUMERIC))
def drop_any_null(spark, folder):
    return clean.drop_any_null(rows(spark, folder, NUMERIC))


@query("fill_missing", with_inputs("SELECT symbol, row_id, coalesce(a, 0.0) AS a, coalesce(b, 0.0) AS b FROM n", n=NUMERIC))
def fill_missing(spark, folder):
    return clean.fill_missing(rows(spark, folder, NUMERIC))


@query("drop_self_loops", "SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey")
def drop_self_loops(spark, folder):
    edges = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return clean.drop_self_loops(edges)


DIRTY_EDGES = f"""SELECT CASE WHEN l_discount = 0 THEN '-' ELSE '$' || {name_of('l_partkey')} END AS src,
CASE WHEN l_tax = 0 THEN 'a-b$' ELSE {name_of('l_suppkey')} END AS dst FROM {{lineitem}}"""


@query(
    "drop_invalid_nodes",
    with_inputs("SELECT replace(src, '$', '') AS src, replace(dst, '$', '') AS dst FROM e WHERE src <> '-' AND dst <> '-'", e=DIRTY_EDGES),
)
def drop_invalid_nodes(spark, folder):
    return clean.drop_invalid_nodes(rows(spark, folder, DIRTY_EDGES))


@query(
    "exclude_rows_by_key",
    "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')",
)
def exclude_rows_by_key(spark, folder):
    bad = table(spark, folder, "part").filter("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("l_partkey"))
    return clean.exclude_rows_by_key(table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), bad, ["l_partkey"])


@query("clean_column_names", "SELECT c_name AS gene, c_acctbal AS \"a_score\", c_mktsegment AS type FROM customer")
def clean_column_names(spark, folder):
    wrapped = table(spark, folder, "customer").select(
        F.concat(F.lit("b'"), "c_name", F.lit("'")).alias("b'gene'"),
        F.col("c_mktsegment").alias("type"),
        F.col("c_acctbal").alias("b'a_score'"),
    )
    return clean.clean_column_names(wrapped, ["gene"])


@query("select_feature_group", "SELECT vec_id, i - 32 AS position, embedding[i] AS value FROM embeddings, (SELECT unnest(range(33, 49)) AS i)")
def select_feature_group(spark, folder):
    group = clean.select_feature_group(table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding", "DNA_Methylation")
    return group.select("vec_id", F.posexplode("embedding").alias("position", "value")).select(
        "vec_id", (F.col("position") + 1).cast("bigint").alias("position"), "value"
    )


RAW_LABELS = "SELECT o_orderkey AS key, CASE WHEN o_totalprice > 300000 THEN 'True' WHEN o_totalprice > 100000 THEN 'False' ELSE NULL END AS label FROM {orders}"


@query("recode_label", with_inputs("SELECT key, CASE label WHEN 'True' THEN 1 WHEN 'False' THEN 0 END AS label FROM r", r=RAW_LABELS))
def recode_label(spark, folder):
    return clean.recode_label(rows(spark, folder, RAW_LABELS), "label")


@query("display_name", "SELECT DISTINCT array_to_string(list_transform(string_split(replace(lower(p_type || '_' || p_name), '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS shown, replace(lower(p_name), ' ', '_') AS slug FROM part")
def display_name_query(spark, folder):
    part = table(spark, folder, "part")
    name = F.lower(F.concat_ws("_", "p_type", "p_name"))
    return part.select(display_name(name).alias("shown"), slug("p_name").alias("slug")).distinct()


@query("columns_subset_drop", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def columns_subset_drop(spark, folder):
    return clean.columns_subset_drop(table(spark, folder, "customer"), "c_nationkey", "c_acctbal")


@query("find_key", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_suppkey = 7")
def find_key(spark, folder):
    return clean.find_key(table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), "l_suppkey", 7)


@query(
    "any_match",
    """SELECT 'p_name' AS "column", bool_or(contains(p_name, 'ring')) AS found FROM part
    UNION ALL SELECT 'p_brand', bool_or(contains(p_brand, 'ring')) FROM part""",
)
def any_match(spark, folder):
    return clean.any_match(table(spark, folder, "part"), ["p_name", "p_brand"], "ring")


# ---------------------------------------------------------------- aggregates and sets over columns


@query("value_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def value_counts(spark, folder):
    return clean.value_counts(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "null_profile",
    with_inputs(
        """SELECT * FROM (SELECT 'oncogene' AS "column", count(*) - count(oncogene) AS nulls FROM f UNION ALL SELECT 'tsg', count(*) - count(tsg) FROM f
        UNION ALL SELECT '(total)', 2 * count(*) - count(tsg) - count(oncogene) FROM f)""",
        f=FLAGGED,
    ),
)
def null_profile(spark, folder):
    return clean.null_profile(rows(spark, folder, FLAGGED).select("oncogene", "tsg"))


@query(
    "feature_range",
    """SELECT min(list_min(embedding)) AS min_value, max(list_max(embedding)) AS max_value, count(*) AS n_rows,
    min(len(embedding))::INT AS min_width, max(len(embedding))::INT AS max_width FROM embeddings""",
)
def feature_range(spark, folder):
    return clean.feature_range(table(spark, folder, "embeddings"), "embedding")


@query(
    "distinct_counts",
    """SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS n_distinct FROM lineitem
    UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem""",
)
def distinct_counts(spark, folder):
    return clean.distinct_counts(table(spark, folder, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"])


@query("sort_by_key", "SELECT c_name, c_custkey FROM customer ORDER BY c_name")
def sort_by_key(spark, folder):
    return clean.sort_by_key(table(spark, folder, "customer").select("c_name", "c_custkey"), "c_name")


@query("head_n", "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20")
def head_n(spark, folder):
    return clean.head_n(table(spark, folder, "customer").select("c_name", "c_acctbal"), [F.col("c_acctbal").desc(), "c_name"], 20)


@query(
    "union_all_sources",
    with_inputs("SELECT *, 0 AS source_rank FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c", a=LIST_A, b=LIST_B, c=LIST_C),
)
def union_all_sources(spark, folder):
    return concat_sources([rows(spark, folder, x) for x in (LIST_A, LIST_B, LIST_C)])


@query("union_distinct_keys", list_sql("SELECT symbol FROM a UNION SELECT symbol FROM b UNION SELECT symbol FROM universe"))
def union_distinct_keys(spark, folder):
    return clean.union_distinct_keys([rows(spark, folder, LIST_INPUTS[x]) for x in ("a", "b", "universe")], "symbol")


@query("intersect_keys", with_inputs("SELECT symbol FROM a INTERSECT SELECT symbol FROM b", a=LIST_A, b=LIST_B))
def intersect_keys(spark, folder):
    return clean.intersect_keys(rows(spark, folder, LIST_A), rows(spark, folder, LIST_B), "symbol")


@query("except_keys", with_inputs("SELECT symbol FROM b EXCEPT SELECT symbol FROM a", a=LIST_A, b=LIST_B))
def except_keys(spark, folder):
    return clean.except_keys(rows(spark, folder, LIST_B), rows(spark, folder, LIST_A), "symbol")
