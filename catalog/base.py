"""Registry of queries and the inputs they share.

Inputs are small portable SQL texts over the given tables.  A table is written ``{customer}``: Spark
gets the text with the frame bound to the name, the SQL check gets the plain name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """An input text as a DataFrame."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{n: table(spark, folder, n) for n in names})


def plain(text: str) -> str:
    """An input text as SQL over the plain table names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def with_inputs(body: str, **inputs: str) -> str:
    """SQL with the inputs as common table expressions (recursive ones allowed)."""
    parts = [f"{name} AS ({plain(text)})" for name, text in inputs.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL text when there is one."""

    def wrap(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# ---------------------------------------------------------------- inputs

def name_of(expression: str) -> str:
    """SQL for the customer name of a key."""
    return f"'Customer#' || lpad(CAST({expression} AS STRING), 9, '0')"


#: synonym dictionary: (input, match_type, approved, seq)
DICTIONARY = f"""
SELECT c_name AS input,
       CASE WHEN c_nationkey < 12 THEN 'Approved symbol' WHEN c_nationkey < 17 THEN 'Alias symbol'
            WHEN c_nationkey < 20 THEN 'Previous symbol' WHEN c_nationkey < 23 THEN 'Unmatched'
            ELSE 'Entry withdrawn' END AS match_type,
       CASE WHEN c_nationkey < 12 THEN c_name
            WHEN c_nationkey < 20 THEN {name_of('c_nationkey')} ELSE NULL END AS approved,
       c_custkey AS seq
FROM {{customer}}
UNION ALL
SELECT {name_of('o_custkey')}, 'Alias symbol', {name_of('o_custkey % 97')}, 1000000000 + o_orderkey
FROM {{orders}} WHERE o_orderstatus = 'P' AND o_totalprice > 400000"""

#: curated lists: (symbol, oncogene, tsg, row_id)
LIST_A = "SELECT c_name AS symbol, c_acctbal > 7000 AS oncogene, c_acctbal < 500 AS tsg, c_custkey AS row_id FROM {customer} WHERE c_mktsegment = 'BUILDING'"
LIST_B = f"SELECT {name_of('o_custkey')} AS symbol, o_totalprice > 450000 AS oncogene, o_orderpriority = '1-URGENT' AS tsg, o_orderkey AS row_id FROM {{orders}} WHERE o_orderstatus = 'F' AND o_totalprice > 300000"
LIST_C = "SELECT c_name AS symbol, c_acctbal > 5000 AS oncogene, c_nationkey = 3 AS tsg, c_custkey AS row_id FROM {customer} WHERE c_mktsegment = 'MACHINERY'"
LIST_D = "SELECT c_name AS symbol, false AS oncogene, false AS tsg, c_custkey AS row_id FROM {customer} WHERE c_mktsegment = 'HOUSEHOLD'"
LIST_E = f"SELECT {name_of('o_custkey')} AS symbol, false AS oncogene, false AS tsg, o_orderkey AS row_id FROM {{orders}} WHERE o_orderstatus = 'O' AND o_totalprice > 470000"

#: pathways: (pathway, members) with mixed separators, null pathways included
PATHWAYS = f"""
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'Pathways in Cancer'
            WHEN o_orderpriority = '2-HIGH' THEN 'small CANCER ' || o_orderstatus
            WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE 'cell cycle' END AS pathway,
       {name_of('o_custkey')} || ', ' || {name_of('o_custkey + 1')} || ' ' || {name_of('o_orderkey % 7919')} || ',' AS members
FROM {{orders}}"""

#: feature universe
UNIVERSE = f"SELECT c_name AS symbol FROM {{customer}} UNION ALL SELECT {name_of('o_custkey')} FROM {{orders}}"

#: mapping and list steps as SQL, for the checks
MAP_SQL = """SELECT input, approved FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY seq DESC) rn
FROM dict WHERE match_type IN ('Approved symbol', 'Alias symbol', 'Previous symbol')) WHERE rn = 1"""
KNOWN_SQL = "SELECT input AS symbol FROM map UNION SELECT approved FROM map WHERE approved IS NOT NULL"


def mapped_sql(source: str) -> str:
    """A list after synonyms: mapped, known symbols only, first row per symbol."""
    return f"""SELECT symbol, oncogene, tsg, row_id FROM (
SELECT coalesce(m.approved, s.symbol) AS symbol, s.oncogene, s.tsg, s.row_id,
       row_number() OVER (PARTITION BY coalesce(m.approved, s.symbol) ORDER BY s.row_id) rn
FROM {source} s LEFT JOIN map m ON s.symbol = m.input
WHERE coalesce(m.approved, s.symbol) IN (SELECT symbol FROM known)) WHERE rn = 1"""


LIST_INPUTS = {
    "dict": DICTIONARY,
    "map": MAP_SQL,
    "known": KNOWN_SQL,
    "a": LIST_A,
    "b": LIST_B,
    "c": LIST_C,
    "d": LIST_D,
    "e": LIST_E,
    "pw": PATHWAYS,
    "universe": UNIVERSE,
    "members": """SELECT DISTINCT symbol FROM (SELECT unnest(regexp_split_to_array(members, '[,\\s]+')) AS symbol
FROM pw WHERE lower(pathway) LIKE '%cancer%') WHERE symbol <> ''""",
    "ma": mapped_sql("a"),
    "mb": mapped_sql("b"),
    "mc": mapped_sql("c"),
    "md": mapped_sql("d"),
    "me": mapped_sql("e"),
    "canonical": """SELECT symbol, bool_or(oncogene) AS oncogene, bool_or(tsg) AS tsg FROM (
SELECT symbol, oncogene, tsg FROM ma UNION ALL SELECT symbol, oncogene, tsg FROM mb
UNION ALL SELECT symbol, oncogene, tsg FROM mc) GROUP BY symbol HAVING bool_or(oncogene) OR bool_or(tsg)""",
    "candidate": """SELECT DISTINCT symbol, false AS oncogene, false AS tsg FROM (SELECT symbol FROM md UNION ALL
SELECT symbol FROM me UNION ALL SELECT symbol FROM members)""",
    "labels0": """SELECT u.symbol,
CASE WHEN c.symbol IS NOT NULL THEN 1 WHEN k.symbol IS NOT NULL THEN NULL ELSE 0 END AS label2,
CASE WHEN c.symbol IS NOT NULL AND c.tsg THEN 1 WHEN c.symbol IS NOT NULL AND c.oncogene THEN 2
     WHEN c.symbol IS NOT NULL THEN 0 WHEN k.symbol IS NOT NULL THEN NULL ELSE 0 END AS label3
FROM (SELECT symbol FROM universe UNION SELECT symbol FROM canonical UNION SELECT symbol FROM candidate) u
LEFT JOIN canonical c ON u.symbol = c.symbol LEFT JOIN candidate k ON u.symbol = k.symbol""",
}


def list_sql(body: str) -> str:
    return with_inputs(body, **LIST_INPUTS)


#: network of every line item: part and supplier numbers share one vertex space
RAW_EDGES = "SELECT l_partkey AS src, l_suppkey AS dst FROM {lineitem}"
EDGES = "SELECT DISTINCT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM {lineitem} WHERE l_partkey <> l_suppkey"
NAMED_EDGES = f"SELECT {name_of('l_partkey')} AS src, {name_of('l_suppkey')} AS dst FROM {{lineitem}}"

#: network of conversation turns: neighbours in time, and the opening turn with every assistant turn
TURN_EDGES = """SELECT conv_id * 100000000 + turn - 1 AS src, conv_id * 100000000 + turn AS dst FROM {conversations} WHERE turn > 0
UNION SELECT conv_id * 100000000, conv_id * 100000000 + turn FROM {conversations} WHERE turn > 0 AND role = 'assistant'"""

#: predictions of all line items: model, three-class truth, prediction and probabilities
PREDICTIONS = """
SELECT model, y_true, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS y_pred, p0, p1, p2
FROM (SELECT model, y_true, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2
FROM (SELECT 'model_' || CAST(l_suppkey % 9 AS STRING) AS model,
             CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y_true,
             l_quantity / 50 AS a, l_discount * 10 + 0.05 AS b, l_tax * 12.5 + 0.1 AS c FROM {lineitem}) s1) s2"""

#: binary predictions: the truth is one return flag, the score the tax part
BINARY = """
SELECT model, y_true, CASE WHEN score > 0.4 THEN 1 ELSE 0 END AS y_pred, score
FROM (SELECT 'model_' || CAST(l_suppkey % 9 AS STRING) AS model, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
             (l_tax * 12.5 + 0.1) / (l_quantity / 50 + l_discount * 10 + l_tax * 12.5 + 0.15) AS score FROM {lineitem}) s1"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    df = rows(spark, folder, PREDICTIONS)
    return df.select("model", "y_true", "y_pred", F.array("p0", "p1", "p2").alias("proba"))


def binary_predictions(spark: SparkSession, folder: str) -> DataFrame:
    df = rows(spark, folder, BINARY)
    return df.select("model", "y_true", "y_pred", F.array(1 - F.col("score"), F.col("score")).alias("proba"))


#: fold results: (model, fold, strategy, accuracy ... pr_auc) from line item averages
FOLDS = """
SELECT 'model_' || CAST(l_suppkey % 9 AS STRING) AS model, l_linenumber AS fold, l_returnflag AS strategy,
       avg(l_quantity) / 51.3 AS accuracy, avg(l_discount) / 0.1013 AS prec, avg(l_tax) / 0.0817 AS recall,
       avg(l_quantity * l_discount) / 5.03 AS f1, avg(l_quantity * l_tax) / 4.07 AS roc_auc, avg(l_discount * l_tax) / 0.00811 AS pr_auc
FROM {lineitem} GROUP BY l_suppkey % 9, l_linenumber, l_returnflag"""

#: trials: (model, fold, trial, score)
TRIALS = """
SELECT 'model_' || CAST(l_suppkey % 9 AS STRING) AS model, l_linenumber AS fold, l_partkey AS trial,
       max(l_quantity * (1 - l_discount)) AS score
FROM {lineitem} GROUP BY l_suppkey % 9, l_linenumber, l_partkey"""

#: entities with a class of very different sizes, for splits
ENTITIES = "SELECT o_orderkey AS key, CASE WHEN o_totalprice > 465000 THEN 1 ELSE 0 END AS label FROM {orders}"

#: embedding rows as a labelled feature matrix, one class against the rest
MATRIX = "SELECT CAST(vec_id AS STRING) AS key, embedding AS features, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM {embeddings}"
