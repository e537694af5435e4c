"""Neighbours, splits and balancing against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import balance, neighbors, splits


def _points(spark, x, labels=None):
    labels = labels if labels is not None else [0] * len(x)
    rows = [(f"k{i:04d}", [float(v) for v in row], int(l)) for i, (row, l) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "key STRING, features ARRAY<DOUBLE>, label INT")


def _brute(x, k, p, exclude_self):
    out = {}
    for i, row in enumerate(x):
        gap = np.abs(x - row)
        d = gap.sum(1) if p == 1 else np.sqrt((gap**2).sum(1))
        order = sorted((d[j], f"k{j:04d}") for j in range(len(x)) if not (exclude_self and j == i))[:k]
        out[f"k{i:04d}"] = order
    return out


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("block_rows", [16, 1000])
def test_knn_join_is_exact(spark, p, block_rows):
    """Clusters far apart (so cells are pruned) and a third of the points identical."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1.0, (30, 3)) for c in (0, 50, 100)] + [np.full((45, 3), 7.0)])
    points = _points(spark, x)
    got = neighbors.knn_join(points, points, 4, p=p, exclude_self=True, block_rows=block_rows).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    expected = _brute(x, 4, p, True)
    assert set(found) == set(expected)
    for key, rows in found.items():
        rows.sort()
        assert [n for _, _, n in rows] == [n for _, n in expected[key]]
        assert [d for _, d, _ in rows] == pytest.approx([d for d, _ in expected[key]])


def test_hashed_knn_recall(spark):
    """Overlapping clusters and a third of the points identical, many buckets, few of them probed."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 1.0, (500, 12)) for c in (0, 1, 2, 3)] + [np.full((1000, 12), 1.5)])
    points = _points(spark, x)
    got = neighbors.knn_join_hashed(points, points, 5, exclude_self=True, bucket_rows=24, probes=6).toPandas()
    assert len(got) == 5 * len(x) and not got.duplicated(["query_id", "neighbor_id"]).any()
    pairs = {(f"k{i:04d}", n) for i, n in zip(got.query_id.str[1:].astype(int), got.neighbor_id)}
    q, d = got.query_id.str[1:].astype(int), got.neighbor_id.str[1:].astype(int)
    assert np.allclose(got.distance, np.sqrt(((x[q] - x[d]) ** 2).sum(1)))
    exact = {(a, n) for a, near in _brute(x, 5, 2, True).items() for _, n in near}
    assert len(pairs & exact) / len(exact) >= 0.9
    # copies have exactly their smallest other ids
    assert set(got[got.query_id == "k2999"].neighbor_id) == {f"k{i}" for i in range(2000, 2005)}


def test_hashed_knn_answers_short_queries_exactly(spark):
    x = np.concatenate([np.arange(60.0)[:, None], [[500.0]]])
    got = neighbors.knn_join_hashed(_points(spark, x), _points(spark, x), 40, tables=1, probes=0, bucket_rows=4).toPandas()
    assert (got.groupby("query_id").size() == 40).all()
    none = _points(spark, x).limit(0)
    assert neighbors.knn_join_hashed(_points(spark, x), none, 3).count() == 0


def test_knn_join_of_other_queries_and_few_points(spark):
    data = _points(spark, np.array([[0.0], [1.0]]))
    queries = spark.createDataFrame([("q", [0.2])], "key STRING, features ARRAY<DOUBLE>")
    got = neighbors.knn_join(queries, data, 5).orderBy("rank").collect()
    assert [(r.neighbor_id, round(r.distance, 6)) for r in got] == [("k0000", 0.2), ("k0001", 0.8)]


def test_knn_votes(spark):
    train = _points(spark, np.array([[0.0], [1.0], [1.1]]), [0, 1, 1])
    test = spark.createDataFrame([("q", [0.0]), ("r", [1.04])], "key STRING, features ARRAY<DOUBLE>")
    uniform = {r.key: r.y_pred for r in neighbors.knn_classify(train, test, 3).collect()}
    weighted = {r.key: list(r.proba) for r in neighbors.knn_classify(train, test, 3, weights="distance").collect()}
    assert uniform == {"q": 1, "r": 1}
    assert weighted["q"] == [1.0, 0.0]


def test_folds(spark):
    df = spark.range(1003).select(F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"))
    sizes = [r.n for r in splits.kfold(df, "key").groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1003 and max(sizes) - min(sizes) <= 1
    per_class = splits.stratified_kfold(df, "key", "label").groupBy("fold", "label").agg(F.count("*").alias("n")).collect()
    for label in (0, 1):
        n = [r.n for r in per_class if r.label == label]
        assert len(n) == 5 and max(n) - min(n) <= 1
    test = splits.stratified_holdout(df, "key", "label").filter("is_test").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in test} == {1: 20, 0: 180}


@pytest.mark.parametrize("partitions", ["1", "7", "64"])
def test_split_does_not_depend_on_partitioning(spark, partitions):
    df = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 3).cast("int").alias("label"))
    want = {(r.key, r.fold) for r in splits.stratified_kfold(df, "key", "label").collect()}
    got = {(r.key, r.fold) for r in splits.stratified_kfold(df.repartition(int(partitions)), "key", "label").collect()}
    assert got == want


def _imbalanced(spark, seed=2):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(1.0, 1, (15, 2))])
    return x, _points(spark, x, [0] * 60 + [1] * 15)


def test_smote_points_lie_on_segments(spark):
    x, points = _imbalanced(spark)
    out = balance.smote(points).toPandas()
    assert (out.label == 0).sum() == (out.label == 1).sum() == 60
    members = x[60:]
    near = {k: [int(n[1:]) for _, n in v] for k, v in _brute(members, 5, 2, True).items()}
    for _, row in out[out.key.str.startswith("synthetic")].iterrows():
        base = int(row.key.split("#")[2][1:]) - 60
        point = np.array(row.features)
        on_segment = False
        for j in near[f"k{base:04d}"]:
            a, b = members[base], members[j]
            u = np.dot(point - a, b - a) / np.dot(b - a, b - a)
            on_segment |= -1e-9 <= u <= 1 + 1e-9 and np.allclose(a + u * (b - a), point)
        assert on_segment


def test_adasyn_kmeans_and_combinations(spark):
    _, points = _imbalanced(spark)
    made = balance.adasyn(points).filter("key LIKE 'synthetic%'").count()
    assert abs(made - 45) <= 15
    assert balance.smote_tomek(points).count() <= 120
    assert balance.smote_enn(points).count() <= 120
    rng = np.random.default_rng(4)
    apart = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(12.0, 1, (15, 2))])
    points = _points(spark, apart, [0] * 60 + [1] * 15)
    assert balance.kmeans_smote(points, k=2, clusters=2).filter("key LIKE 'synthetic%'").count() >= 45


def test_known_tomek_pair_and_noisy_point(spark):
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1], [10, 10], [10, 10.5], [10.5, 10], [5, 5], [5.1, 5]], dtype=float)
    points = _points(spark, x, [0, 0, 0, 0, 1, 1, 1, 0, 1])
    kept = {r.key for r in balance.tomek_links(points).collect()}
    assert kept == {f"k{i:04d}" for i in range(9)} - {"k0007"}
    both = {r.key for r in balance.tomek_links(points, all_classes=True).collect()}
    assert both == kept - {"k0008"}
    edited = {r.key for r in balance.edited_nn(points).collect()}
    assert "k0007" not in edited and "k0008" in edited


def test_dispatcher(spark):
    _, points = _imbalanced(spark)
    assert balance.balance(points, None) is points
    assert balance.balance(points, "randomundersampler").count() == 30
    with pytest.raises(ValueError):
        balance.balance(points, "absent")
    with pytest.raises(ValueError):
        balance.smote(_points(spark, np.zeros((5, 1)), [0, 0, 0, 0, 1]))


def test_too_many_classes_are_an_error(spark):
    rows = spark.range(1200).selectExpr("id AS label", "id AS key")
    with pytest.raises(ValueError, match="classes"):
        balance.class_counts(rows)
    assert balance.undersample_random(rows).count() == 1200


def test_knn_join_ships_points_once_per_strip(spark):
    """Blocks of points are not joined in pairs, and copies of one point do not fill a task."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(300, 6)), np.repeat(rng.normal(size=(1, 6)), 200, 0)])
    points = _points(spark, x)
    near = neighbors.knn_join(points, points, 3, exclude_self=True, block_rows=20)
    plan = near._jdf.queryExecution().toString()
    assert "q_block" not in plan and "d_block" not in plan
    got = near.toPandas()
    between = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(between, np.inf)
    ids = points.orderBy(F.col("key")).select("key").toPandas()["key"].tolist()
    assert len(got) == 3 * len(x) and set(got["query_id"]) == set(ids)
    assert np.allclose(np.sort(got["distance"]), np.sort(np.sort(between, 1)[:, :3].ravel()))
