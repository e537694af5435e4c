"""Synonym, list, label and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    DICTIONARY,
    LIST_A,
    LIST_B,
    LIST_C,
    LIST_D,
    LIST_E,
    LIST_INPUTS,
    NAMED_EDGES,
    PATHWAYS,
    UNIVERSE,
    list_sql,
    name_of,
    query,
    rounded,
    rows,
    table,
    with_inputs,
)
from labelweave.operators import clean, labels, synonyms
from labelweave.operators.dedupe import dedupe_first, dedupe_last
from labelweave.plans.entities import label_entities as label_all
from labelweave.runtime import stage

KEYS = ["symbol", "oncogene", "tsg"]


def mapping_of(spark, folder):
    return stage(synonyms.build_synonym_map(rows(spark, folder, DICTIONARY)), "mapping")


def canonical_of(spark, folder, mapping, ordered=False):
    return labels.canonical_list([rows(spark, folder, x) for x in (LIST_A, LIST_B, LIST_C)], mapping, ordered=ordered)


def pathway_members(spark, folder):
    hits = clean.filter_keyword_ci(rows(spark, folder, PATHWAYS), "pathway", "cancer")
    members = clean.split_explode_members(hits, "members")
    return clean.standardize(members, F.col("symbol"), F.lit(False), F.lit(False))


def candidate_of(spark, folder, mapping, ordered=False):
    return labels.candidate_list(
        [rows(spark, folder, x) for x in (LIST_D, LIST_E)], [pathway_members(spark, folder)], mapping, ordered=ordered
    )


@query("build_synonym_map", with_inputs("SELECT input, approved FROM map", dict=DICTIONARY, map=LIST_INPUTS["map"]))
def build_synonym_map(spark, folder):
    return synonyms.build_synonym_map(rows(spark, folder, DICTIONARY))


@query(
    "unresolved_inputs",
    with_inputs(
        "SELECT input, match_type, coalesce(approved, 'N/A') AS approved FROM dict WHERE match_type IN ('Unmatched', 'Entry withdrawn')",
        dict=DICTIONARY,
    ),
)
def unresolved_inputs(spark, folder):
    return synonyms.unresolved_inputs(rows(spark, folder, DICTIONARY))


#: a second dictionary: (input, match_type, approved, seq)
SECOND = f"SELECT {name_of('o_custkey')} AS input, 'Alias symbol' AS match_type, {name_of('o_custkey + 1')} AS approved, o_orderkey AS seq FROM {{orders}}"


@query(
    "first_match_dictionary",
    with_inputs(
        """SELECT input, approved FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY r, seq) rn FROM
        (SELECT *, 0 AS r FROM dict UNION ALL SELECT *, 1 FROM second)) WHERE rn = 1""",
        dict=DICTIONARY,
        second=SECOND,
    ),
)
def first_match_dictionary(spark, folder):
    return synonyms.first_match_dictionary([rows(spark, folder, DICTIONARY), rows(spark, folder, SECOND)])


@query("apply_synonyms", list_sql("SELECT symbol, oncogene, tsg, row_id FROM mb"))
def apply_synonyms(spark, folder):
    return synonyms.apply_synonyms(rows(spark, folder, LIST_B), mapping_of(spark, folder))


@query(
    "apply_synonyms_merged_flags",
    list_sql(
        """SELECT symbol, bool_or(oncogene) AS oncogene, bool_or(tsg) AS tsg FROM
        (SELECT coalesce(m.approved, b.symbol) AS symbol, oncogene, tsg FROM b LEFT JOIN map m ON b.symbol = m.input)
        WHERE symbol IN (SELECT symbol FROM known) GROUP BY symbol"""
    ),
)
def apply_synonyms_merged_flags(spark, folder):
    return synonyms.apply_synonyms(rows(spark, folder, LIST_B), mapping_of(spark, folder), merge_flags=True)


@query(
    "removed_symbols",
    list_sql(
        """SELECT DISTINCT coalesce(m.approved, b.symbol) AS symbol FROM b LEFT JOIN map m ON b.symbol = m.input
        WHERE coalesce(m.approved, b.symbol) NOT IN (SELECT symbol FROM known)"""
    ),
)
def removed_symbols(spark, folder):
    return synonyms.removed_symbols(rows(spark, folder, LIST_B), mapping_of(spark, folder))


#: dictionary in which some inputs map to nothing
LOSSY = """SELECT c_name AS input, CASE WHEN c_nationkey = 5 THEN NULL ELSE 'Customer#' || lpad(CAST(c_nationkey AS STRING), 9, '0') END AS approved
FROM {customer} WHERE c_mktsegment <> 'BUILDING'"""
TRANSLATED = """SELECT CASE WHEN x.input IS NOT NULL THEN x.approved ELSE e.src END AS src,
CASE WHEN y.input IS NOT NULL THEN y.approved ELSE e.dst END AS dst
FROM edges e LEFT JOIN lossy x ON e.src = x.input LEFT JOIN lossy y ON e.dst = y.input"""


@query("translate_edges", with_inputs("SELECT src, dst FROM t WHERE src IS NOT NULL AND dst IS NOT NULL", edges=NAMED_EDGES, lossy=LOSSY, t=TRANSLATED))
def translate_edges(spark, folder):
    return synonyms.translate_edges(rows(spark, folder, NAMED_EDGES), rows(spark, folder, LOSSY))


@query(
    "clean_network",
    with_inputs(
        "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM t WHERE src <> dst",
        edges=NAMED_EDGES,
        lossy=LOSSY,
        t=TRANSLATED,
    ),
)
def clean_network(spark, folder):
    from labelweave.operators.graph import clean_network as run

    return run(rows(spark, folder, NAMED_EDGES), rows(spark, folder, LOSSY))


KEY_LABELS = f"SELECT {name_of('o_custkey')} AS symbol, o_orderkey AS row_id, o_totalprice > 300000 AS label FROM {{orders}}"


@query(
    "translate_labels",
    with_inputs(
        """SELECT symbol, row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY row_id) rn FROM
        (SELECT CASE WHEN x.input IS NOT NULL THEN x.approved ELSE l.symbol END AS symbol, row_id, label
         FROM labels l LEFT JOIN lossy x ON l.symbol = x.input) WHERE symbol IS NOT NULL) WHERE rn = 1""",
        labels=KEY_LABELS,
        lossy=LOSSY,
    ),
)
def translate_labels(spark, folder):
    return synonyms.translate_labels(rows(spark, folder, KEY_LABELS), rows(spark, folder, LOSSY), "symbol", ["row_id"])


@query(
    "resolve_edge_names",
    "SELECT p.p_name AS src, s.s_name AS dst FROM lineitem l JOIN part p ON l_partkey = p_partkey JOIN (SELECT s_suppkey, p_name AS s_name FROM supplier JOIN part ON s_suppkey = p_partkey) s ON l_suppkey = s_suppkey",
)
def resolve_edge_names(spark, folder):
    nodes = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    edges = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src_id"), F.col("l_suppkey").alias("dst_id"))
    return synonyms.resolve_edge_names(edges, nodes)


# ---------------------------------------------------------------- lists and labels


@query("any_flag_by_key", with_inputs("SELECT symbol, bool_or(oncogene) AS oncogene, bool_or(tsg) AS tsg FROM b GROUP BY symbol", b=LIST_B))
def any_flag_by_key(spark, folder):
    return labels.any_flag_by_key(rows(spark, folder, LIST_B))


@query("canonical_list", list_sql("SELECT * FROM canonical"))
def canonical_list(spark, folder):
    return canonical_of(spark, folder, mapping_of(spark, folder), ordered=True)


@query("candidate_list", list_sql("SELECT * FROM candidate"))
def candidate_list(spark, folder):
    return candidate_of(spark, folder, mapping_of(spark, folder), ordered=True)


@query("disease_associated_list", list_sql("SELECT symbol FROM members UNION SELECT symbol FROM e"))
def disease_associated_list(spark, folder):
    members = pathway_members(spark, folder).select("symbol")
    return labels.disease_associated_list(members, rows(spark, folder, LIST_E).select("symbol"))


def labels_of(spark, folder):
    mapping = mapping_of(spark, folder)
    return labels.assign_labels(
        rows(spark, folder, UNIVERSE), canonical_of(spark, folder, mapping), candidate_of(spark, folder, mapping)
    )


@query("assign_labels", list_sql("SELECT symbol, label2, label3 FROM labels0"))
def assign_labels(spark, folder):
    return labels_of(spark, folder)


@query("label_entities", list_sql("SELECT label2, label3, count(*) AS n FROM labels0 GROUP BY ALL"))
def label_entities(spark, folder):
    labelled = label_all(
        rows(spark, folder, UNIVERSE),
        [rows(spark, folder, x) for x in (LIST_A, LIST_B, LIST_C)],
        [rows(spark, folder, x) for x in (LIST_D, LIST_E)],
        [pathway_members(spark, folder)],
        synonyms.build_synonym_map(rows(spark, folder, DICTIONARY)),
    )
    return clean.value_counts(labelled, ["label2", "label3"])


@query(
    "label_stats",
    list_sql(
        """SELECT count(*) AS n_total, count(*) - count(label3) AS n_unlabeled, count(*) FILTER (label3 = 0) AS n_class_0,
        count(*) FILTER (label3 = 1) AS n_class_1, count(*) FILTER (label3 = 2) AS n_class_2 FROM labels0"""
    ),
)
def label_stats(spark, folder):
    return labels.label_stats(labels_of(spark, folder), "label3", [0, 1, 2])


@query(
    "class_ratio",
    list_sql(
        """SELECT count(*) FILTER (label2 = 1) AS n_positive, count(*) FILTER (label2 = 0) AS n_negative,
        round(count(*) FILTER (label2 = 1) / count(*) FILTER (label2 = 0), 6) AS ratio FROM labels0"""
    ),
)
def class_ratio(spark, folder):
    return rounded(labels.class_ratio(labels_of(spark, folder), "label2"))


@query("prepare_labels", list_sql("SELECT symbol, label3 AS label FROM labels0 WHERE label3 IS NOT NULL"))
def prepare_labels(spark, folder):
    return labels.prepare_labels(labels_of(spark, folder), "symbol", "multiclass")


MEMBERSHIP = """SELECT p_partkey, p_size > 30 AS driver, p_size < 10 AS candidate FROM {part}"""


@query(
    "tri_state_label",
    with_inputs("SELECT *, CASE WHEN driver THEN true WHEN candidate THEN NULL ELSE false END AS label FROM m", m=MEMBERSHIP),
)
def tri_state_label(spark, folder):
    return labels.tri_state_label(rows(spark, folder, MEMBERSHIP), "driver", "candidate")


@query("dedupe_first", with_inputs("SELECT symbol, oncogene, tsg, row_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY row_id) rn FROM b) WHERE rn = 1", b=LIST_B))
def dedupe_first_query(spark, folder):
    return dedupe_first(rows(spark, folder, LIST_B), ["symbol"], ["row_id"])


@query("dedupe_last", with_inputs("SELECT symbol, oncogene, tsg, row_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY row_id DESC) rn FROM b) WHERE rn = 1", b=LIST_B))
def dedupe_last_query(spark, folder):
    return dedupe_last(rows(spark, folder, LIST_B), ["symbol"], ["row_id"])


# ---------------------------------------------------------------- joins of entities


@query(
    "align_features_labels",
    "SELECT vec_id AS doc_id, label AS vec_label, quality, toxic FROM embeddings JOIN labels ON vec_id = doc_id",
)
def align_features_labels(spark, folder):
    features = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("vec_label"))
    return labels.align_features_labels(features, table(spark, folder, "labels"), "doc_id")


@query(
    "prepare_dataset",
    """SELECT doc_id, toxic AS label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, len(embedding)::INT AS width
    FROM embeddings JOIN labels ON vec_id = doc_id""",
)
def prepare_dataset(spark, folder):
    features = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("features"))
    wide = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label2"), F.col("quality").alias("label3"))
    ready = labels.prepare_dataset(features, wide, "doc_id", "binary")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rounded(ready.select("doc_id", "label", total.alias("total"), F.size("features").alias("width")))


@query(
    "three_way_unlabeled",
    list_sql(
        """SELECT symbol, CASE WHEN bool_or(o = 0) THEN 'candidate' ELSE 'associated' END AS origin FROM
        (SELECT symbol, 0 AS o FROM candidate UNION ALL SELECT symbol, 1 FROM e) WHERE symbol NOT IN (SELECT symbol FROM canonical) GROUP BY symbol"""
    ),
)
def three_way_unlabeled(spark, folder):
    mapping = mapping_of(spark, folder)
    return labels.three_way_unlabeled(
        candidate_of(spark, folder, mapping), rows(spark, folder, LIST_E), canonical_of(spark, folder, mapping)
    )


@query("exclude_canonical", list_sql("SELECT * FROM candidate WHERE symbol NOT IN (SELECT symbol FROM canonical)"))
def exclude_canonical(spark, folder):
    mapping = mapping_of(spark, folder)
    return labels.exclude_canonical(candidate_of(spark, folder, mapping), canonical_of(spark, folder, mapping))


@query(
    "membership_flag",
    "SELECT in_lineitem, count(*) AS n FROM (SELECT p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS in_lineitem FROM part) GROUP BY 1",
)
def membership_flag(spark, folder):
    big = table(spark, folder, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    flagged = labels.membership_flag(table(spark, folder, "part").select("p_partkey"), big, "p_partkey", "in_lineitem")
    return clean.value_counts(flagged, ["in_lineitem"])


@query("restrict_to_network", "SELECT p_partkey AS vertex, p_size > 25 AS label FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem UNION SELECT l_suppkey FROM lineitem)")
def restrict_to_network(spark, folder):
    from labelweave.operators.graph import vertices

    edges = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    known = table(spark, folder, "part").select(F.col("p_partkey").alias("vertex"), (F.col("p_size") > 25).alias("label"))
    return labels.restrict_to_network(known, vertices(edges), "vertex")


#: feature rows of three networks: (symbol, value), priority by table
FEATURE_TABLES = (
    "SELECT c_name AS symbol, c_acctbal AS value FROM {customer} WHERE c_mktsegment = 'BUILDING'",
    f"SELECT {name_of('o_custkey')} AS symbol, max(o_totalprice) AS value FROM {{orders}} WHERE o_orderstatus = 'F' GROUP BY o_custkey",
    "SELECT c_name AS symbol, -c_acctbal AS value FROM {customer}",
)
FEATURE_UNION = """SELECT symbol, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r) rn FROM
(SELECT *, 0 AS r FROM f0 UNION ALL SELECT *, 1 FROM f1 UNION ALL SELECT *, 2 FROM f2)) WHERE rn = 1"""


@query("feature_dictionary_union", with_inputs(FEATURE_UNION, f0=FEATURE_TABLES[0], f1=FEATURE_TABLES[1], f2=FEATURE_TABLES[2]))
def feature_dictionary_union(spark, folder):
    return labels.feature_dictionary_union([rows(spark, folder, t) for t in FEATURE_TABLES], "symbol", ["value"])


LABEL_TABLES = (
    "SELECT c_name AS symbol, c_nationkey < 3 AS label FROM {customer} WHERE c_mktsegment = 'MACHINERY'",
    f"SELECT {name_of('o_custkey')} AS symbol, max(o_totalprice) > 480000 AS label FROM {{orders}} GROUP BY o_custkey",
    "SELECT c_name AS symbol, CAST(NULL AS BOOLEAN) AS label FROM {customer}",
)
LABEL_UNION = FEATURE_UNION.replace("value", "label")


@query("label_union", with_inputs(LABEL_UNION, f0=LABEL_TABLES[0], f1=LABEL_TABLES[1], f2=LABEL_TABLES[2]))
def label_union(spark, folder):
    return labels.label_union([rows(spark, folder, t) for t in LABEL_TABLES], "symbol", ["label"])


@query(
    "enrich_nodes",
    """SELECT v.vertex, p_retailprice AS price, s_acctbal AS balance FROM (SELECT l_partkey AS vertex FROM lineitem UNION SELECT l_suppkey FROM lineitem) v
    LEFT JOIN part ON vertex = p_partkey LEFT JOIN supplier ON vertex = s_suppkey""",
)
def enrich_nodes(spark, folder):
    from labelweave.operators.graph import degree

    edges = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    features = table(spark, folder, "part").select(F.col("p_partkey").alias("vertex"), F.col("p_retailprice").alias("price"))
    targets = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("vertex"), F.col("s_acctbal").alias("balance"))
    return labels.enrich_nodes(degree(edges), features, targets, "vertex", drop=["degree"])
