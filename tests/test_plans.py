"""Physical plans: no nested loops, pruned scans, limited windows, no driver-side collection."""

from __future__ import annotations

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog.base import table
from labelweave.operators import dedupe, graph
from labelweave.operators.synonyms import translate_edges
from labelweave.runtime import stage

FOLDER = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["label_entities", "clean_network", "averaged_auc", "union_networks", "curve_on_grid", "kfold", "parse_params"])
def test_no_nested_loop_joins(spark, name):
    plan = _plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_first_rows_limit_groups_before_the_shuffle(spark):
    plan = _plan(dedupe.dedupe_first(table(spark, FOLDER, "lineitem"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber"]))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_scan_is_pruned_and_filtered(spark):
    df = table(spark, FOLDER, "lineitem").filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey")
    plan = _plan(graph.degree(df.toDF("src", "dst")))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,A)]" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_returnflag:string>" in plan


def test_lists_are_resolved_in_one_pass(spark):
    """All lists together: one shuffle for the dictionary and one per united list, then one for the labels."""
    plan = _plan(entry.queries()["assign_labels"](spark, FOLDER))
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plan)) <= 6
    assert plan.count("BroadcastExchange") <= 3


def test_unpacked_neighbour_arrays_are_not_broadcast(spark):
    """An array per edge takes the driver's memory however small the staged file is."""
    edges = stage(spark.range(400).select((F.col("id") % 20).alias("src"), (F.floor(F.col("id") / 20) + 100).alias("dst")), "edges")
    plan = _plan(graph.local_clustering(edges))
    assert "posexplode(out" in plan
    for line in plan.splitlines():
        assert not ("BroadcastHashJoin" in line and "array_intersect" in line), line


def test_library_text():
    """No local checkpoints, no collection of row-scale frames, no cross joins."""
    for path in (ROOT / "labelweave").rglob("*.py"):
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", "toPandas(", ".rdd"):
            assert word not in text, (path, word)


def test_hot_endpoint_is_split_by_the_join(spark):
    """With a third of the edges on one vertex, AQE splits its partition of the dictionary join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 300_000
        edges = spark.range(0, n, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id") % 5000)).alias("src"),
            F.concat(F.lit("w"), "id").alias("dst"),
        )
        mapping = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("input"), F.concat(F.lit("n"), "id").alias("approved"))
        mapping = mapping.unionByName(spark.createDataFrame([("hot", "HOT")], "input STRING, approved STRING"))
        out = translate_edges(edges, stage(mapping))
        counted = out.groupBy((F.col("src") == "HOT").alias("hot")).agg(F.count("*").alias("n"))
        assert {r.hot: r.n for r in counted.collect()} == {True: n // 3, False: n - n // 3}
        assert "skew=true" in _plan(counted)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
