"""Split, neighbour and balancing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ENTITIES, MATRIX, query, rounded, rows, with_inputs
from labelweave.operators import balance, clean, neighbors, splits

# ---------------------------------------------------------------- splits

NUMBERED = "SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || key), key) AS rn, count(*) OVER (PARTITION BY label) AS nc FROM e"


@query("stratified_holdout", with_inputs("SELECT key, label, rn <= round(0.2::DOUBLE * nc) AS is_test FROM n", e=ENTITIES, n=NUMBERED))
def stratified_holdout(spark, folder):
    return splits.stratified_holdout(rows(spark, folder, ENTITIES), "key", "label")


@query("kfold", with_inputs("SELECT key, label, ((row_number() OVER (ORDER BY md5('42|' || key), key) - 1) % 5)::INT AS fold FROM e", e=ENTITIES))
def kfold(spark, folder):
    return splits.kfold(rows(spark, folder, ENTITIES), "key")


@query("stratified_kfold", with_inputs("SELECT key, label, ((rn - 1) % 5)::INT AS fold FROM n", e=ENTITIES, n=NUMBERED))
def stratified_kfold(spark, folder):
    return splits.stratified_kfold(rows(spark, folder, ENTITIES), "key", "label")


@query(
    "nested_folds",
    with_inputs(
        """SELECT key, label, outer_fold, CASE WHEN own = outer_fold THEN 'test' ELSE 'train' END AS role,
        CASE WHEN own = outer_fold THEN NULL ELSE ((row_number() OVER (PARTITION BY outer_fold, own = outer_fold, label ORDER BY md5('43|' || key), key) - 1) % 5)::INT END AS inner_fold
        FROM (SELECT key, label, ((rn - 1) % 5)::INT AS own FROM n), (SELECT unnest(range(5))::INT AS outer_fold)""",
        e=ENTITIES,
        n=NUMBERED,
    ),
)
def nested_folds(spark, folder):
    return splits.nested_folds(rows(spark, folder, ENTITIES), "key", "label")


@query("balanced_class_weights", with_inputs("SELECT key, label, round((SELECT count(*) FROM e) / (2 * nc), 6) AS weight FROM n", e=ENTITIES, n=NUMBERED))
def balanced_class_weights(spark, folder):
    return rounded(splits.balanced_class_weights(rows(spark, folder, ENTITIES), "label"))


@query("imbalance_ratio", with_inputs("SELECT round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 6) AS ratio, round(93 / 7, 6) AS assumed FROM e", e=ENTITIES))
def imbalance_ratio(spark, folder):
    return rounded(splits.imbalance_ratio(rows(spark, folder, ENTITIES), "label"))


# ---------------------------------------------------------------- neighbours

POINTS = "SELECT key, label, CAST(features AS DOUBLE[]) AS x FROM m"


def knn_sql(q: str, d: str, k: int, exclude_self: bool = True, distance: str = "list_distance(q.x, d.x)") -> str:
    own = "WHERE q.key <> d.key" if exclude_self else ""
    return f"""SELECT query_id, neighbor_id, distance, rn::INT AS rank FROM (SELECT q.key AS query_id, d.key AS neighbor_id, {distance} AS distance,
row_number() OVER (PARTITION BY q.key ORDER BY {distance}, d.key) rn FROM {q} q, {d} d {own}) WHERE rn <= {k}"""


MANHATTAN = "list_sum(list_transform(list_zip(q.x, d.x), lambda z: abs(z[1] - z[2])))"


def matrix(spark, folder):
    return rows(spark, folder, MATRIX)


@query("knn_join", with_inputs("SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank FROM nn", m=MATRIX, p=POINTS, nn=knn_sql("p", "p", 5)))
def knn_join(spark, folder):
    points = matrix(spark, folder)
    return rounded(neighbors.knn_join(points, points, 5, exclude_self=True))


# hashed buckets are approximate on large tables; on the given ones their recall is 1
@query("knn_join_hashed", with_inputs("SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank FROM nn", m=MATRIX, p=POINTS, nn=knn_sql("p", "p", 5)))
def knn_join_hashed(spark, folder):
    points = matrix(spark, folder)
    return rounded(neighbors.knn_join_hashed(points, points, 5, exclude_self=True))


@query(
    "knn_join_manhattan",
    with_inputs("SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank FROM nn", m=MATRIX, p=POINTS, nn=knn_sql("p", "p", 3, True, MANHATTAN)),
)
def knn_join_manhattan(spark, folder):
    points = matrix(spark, folder)
    return rounded(neighbors.knn_join(points, points, 3, p=1, exclude_self=True, block_rows=128))


SPLIT = "SELECT *, rn <= round(0.2::DOUBLE * nc) AS is_test FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || key), key) AS rn, count(*) OVER (PARTITION BY label) AS nc FROM p)"


@query(
    "train_knn",
    with_inputs(
        """SELECT query_id AS key, CASE WHEN w1 > w0 THEN 1 ELSE 0 END AS y_pred, round(w1 / (w0 + w1), 6) AS score FROM
        (SELECT query_id, sum(CASE WHEN label = 0 THEN 1 / distance ELSE 0 END) AS w0, sum(CASE WHEN label = 1 THEN 1 / distance ELSE 0 END) AS w1
         FROM nn JOIN p ON neighbor_id = key GROUP BY query_id)""",
        m=MATRIX,
        p=POINTS,
        s=SPLIT,
        te="SELECT * FROM s WHERE is_test",
        tr="SELECT * FROM s WHERE NOT is_test",
        nn=knn_sql("te", "tr", 5, False),
    ),
)
def train_knn(spark, folder):
    split = splits.stratified_holdout(matrix(spark, folder), "key", "label")
    train, test = split.filter("NOT is_test"), split.filter("is_test")
    scored = neighbors.knn_classify(train, test, 5, weights="distance")
    return rounded(scored.select("key", "y_pred", F.element_at("proba", 2).alias("score")))


# ---------------------------------------------------------------- balancing


@query(
    "undersample_random",
    with_inputs(
        "SELECT key, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || key), key) AS rn, min(nc) OVER () AS smallest FROM n) WHERE rn <= smallest",
        e=ENTITIES,
        n="SELECT *, count(*) OVER (PARTITION BY label) AS nc FROM e",
    ),
)
def undersample_random(spark, folder):
    return balance.undersample_random(rows(spark, folder, ENTITIES))


def unit_sql(seed: str, *columns: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in columns]])
    return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) / 281474976710656)"


def synthetic_sql(k: int) -> str:
    """Synthetic minority points from ``copies(key, n)`` and the members' own neighbours ``own``."""
    return f"""SELECT 'synthetic#1#' || c.key || '#' || c.copy AS key, 1 AS label,
list_transform(list_zip(a.x, b.x), lambda z: z[1] + {unit_sql('42u', 'c.key', 'c.copy')} * (z[2] - z[1])) AS x
FROM (SELECT key, unnest(range(1, n + 1))::INT AS copy FROM copies) c
JOIN own ON own.query_id = c.key AND own.rank = floor({unit_sql('42n', 'c.key', 'c.copy')} * {k}) + 1
JOIN p a ON a.key = c.key JOIN p b ON b.key = own.neighbor_id"""


EVEN = """SELECT key, (SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) FROM p) // nc
+ (rn <= (SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) FROM p) % nc)::INT AS n FROM
(SELECT key, row_number() OVER (ORDER BY md5('42c|' || key), key) AS rn, count(*) OVER () AS nc FROM p WHERE label = 1)"""

SMOTE_INPUTS = {
    "m": MATRIX,
    "p": POINTS,
    "mem": "SELECT * FROM p WHERE label = 1",
    "own": knn_sql("mem", "mem", 5),
    "copies": EVEN,
    "syn": synthetic_sql(5),
    "allp": "SELECT key, label, x FROM p UNION ALL SELECT key, label, x FROM syn",
}
SUMMARY = "SELECT key, label, round(list_sum(x), 6) AS total, round(x[1], 6) AS first FROM "


def summary(df):
    """Rows with the sum and the first of their features, enough to compare points."""
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rounded(df.select("key", "label", total.alias("total"), F.get("features", F.lit(0)).alias("first")))


@query("smote", with_inputs(SUMMARY + "allp", **SMOTE_INPUTS))
def smote(spark, folder):
    return summary(balance.smote(matrix(spark, folder)))


@query(
    "adasyn",
    with_inputs(
        SUMMARY + "(SELECT key, label, x FROM p UNION ALL SELECT key, label, x FROM syn)",
        **{
            **{n: SMOTE_INPUTS[n] for n in ("m", "p", "mem", "own")},
            "hood": knn_sql("mem", "p", 5),
            "hard": "SELECT query_id AS key, count(*) FILTER (label <> 1) / 5 AS h FROM hood JOIN p ON neighbor_id = p.key GROUP BY query_id",
            "copies": """SELECT key, CAST(round_even(h / (SELECT sum(h) FROM hard) * (SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) FROM p), 0) AS BIGINT) AS n FROM hard""",
            "syn": synthetic_sql(5),
        },
    ),
)
def adasyn(spark, folder):
    return summary(balance.adasyn(matrix(spark, folder)))


def tomek_sql(source: str, all_classes: bool) -> str:
    """Keys to remove: members of mutual nearest-neighbour pairs of different classes."""
    which = "" if all_classes else "AND a.label = 0"
    return f"""SELECT x.query_id AS key FROM near1 x JOIN near1 y ON x.neighbor_id = y.query_id AND y.neighbor_id = x.query_id
JOIN {source} a ON a.key = x.query_id JOIN {source} b ON b.key = x.neighbor_id WHERE a.label <> b.label {which}"""


def enn_sql(source: str, all_classes: bool) -> str:
    which = "" if all_classes else "AND a.label = 0"
    return f"""SELECT x.query_id AS key FROM near3 x JOIN {source} a ON a.key = x.query_id JOIN {source} b ON b.key = x.neighbor_id
WHERE a.label <> b.label {which}"""


@query(
    "tomek_links",
    with_inputs("SELECT key, label FROM p WHERE key NOT IN (SELECT key FROM gone)", m=MATRIX, p=POINTS, near1=knn_sql("p", "p", 1), gone=tomek_sql("p", False)),
)
def tomek_links(spark, folder):
    return balance.tomek_links(matrix(spark, folder)).select("key", "label")


@query(
    "edited_nn",
    with_inputs("SELECT key, label FROM p WHERE key NOT IN (SELECT key FROM gone)", m=MATRIX, p=POINTS, near3=knn_sql("p", "p", 3), gone=enn_sql("p", False)),
)
def edited_nn(spark, folder):
    return balance.edited_nn(matrix(spark, folder)).select("key", "label")


@query(
    "smote_enn",
    with_inputs(SUMMARY + "allp WHERE key NOT IN (SELECT key FROM gone)", **SMOTE_INPUTS, near3=knn_sql("allp", "allp", 3), gone=enn_sql("allp", True)),
)
def smote_enn(spark, folder):
    return summary(balance.smote_enn(matrix(spark, folder)))


@query(
    "smote_tomek",
    with_inputs(SUMMARY + "allp WHERE key NOT IN (SELECT key FROM gone)", **SMOTE_INPUTS, near1=knn_sql("allp", "allp", 1), gone=tomek_sql("allp", True)),
)
def smote_tomek(spark, folder):
    return summary(balance.smote_tomek(matrix(spark, folder)))


@query("kmeans_smote")
def kmeans_smote(spark, folder):
    wider = "CASE WHEN label < 4 THEN 1 ELSE 0 END AS label"
    points = rows(spark, folder, MATRIX.replace("CASE WHEN label = 0 THEN 1 ELSE 0 END AS label", wider))
    return summary(balance.kmeans_smote(points, k=2, clusters=3))


@query("balance", with_inputs("SELECT label, nmin AS n FROM (SELECT DISTINCT label, (SELECT min(n) FROM (SELECT count(*) AS n FROM m GROUP BY label)) AS nmin FROM m)", m=MATRIX))
def balance_query(spark, folder):
    return clean.value_counts(balance.balance(matrix(spark, folder), "randomundersampler"), ["label"])
