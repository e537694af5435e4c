"""Edge cases of cleaning, synonyms and labels."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from labelweave.functions.text import parse_run_folder, strategy_name
from labelweave.operators import clean, dedupe, labels, synonyms
from labelweave.runtime import stage
from labelweave.sources import readers, writers

DICTIONARY = [
    ("OLD", "Alias symbol", "NEW", 1),
    ("OLD", "Previous symbol", "NEWER", 2),
    ("NEW", "Approved symbol", "NEW", 3),
    ("GONE", "Entry withdrawn", None, 4),
    ("WHAT", "Unmatched", None, 5),
    ("VOID", "Alias symbol", None, 6),
]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "input STRING, match_type STRING, approved STRING, seq INT")


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_last_and_first_duplicate(dictionary):
    assert ("OLD", "NEWER") in _rows(synonyms.build_synonym_map(dictionary), "input", "approved")
    first = {r.input: r.approved for r in synonyms.first_match_dictionary([dictionary]).collect()}
    assert first["OLD"] == "NEW"
    assert _rows(synonyms.unresolved_inputs(dictionary), "input", "approved") == [("GONE", "N/A"), ("WHAT", "N/A")]


def test_apply_synonyms_keeps_known_first_rows(spark, dictionary):
    mapping = synonyms.build_synonym_map(dictionary)
    data = [(1, "NEWER", False, True), (2, "OLD", True, False), (3, "WHAT", True, True), (4, "VOID", True, False)]
    listed = spark.createDataFrame(data, "row_id INT, symbol STRING, oncogene BOOLEAN, tsg BOOLEAN")
    kept = synonyms.apply_synonyms(listed, mapping)
    # OLD becomes NEWER, which an earlier row already holds; VOID maps to nothing and stays itself
    assert _rows(kept, "symbol", "oncogene", "tsg") == [("NEWER", False, True), ("VOID", True, False)]
    merged = synonyms.apply_synonyms(listed, mapping, merge_flags=True)
    assert ("NEWER", True, True) in _rows(merged, "symbol", "oncogene", "tsg")
    assert _rows(synonyms.removed_symbols(listed, mapping), "symbol") == [("WHAT",)]


def test_translate_edges_drops_names_mapped_to_nothing(spark):
    mapping = spark.createDataFrame([("a", "A"), ("v", None)], "input STRING, approved STRING")
    edges = spark.createDataFrame([("a", "x"), ("a", "v"), ("x", "y")], "src STRING, dst STRING")
    assert _rows(synonyms.translate_edges(edges, mapping), "src", "dst") == [("A", "x"), ("x", "y")]


def test_three_valued_flags(spark):
    flags = [(None, None), (True, None), (False, None), (False, False), (True, True)]
    df = spark.createDataFrame(flags, "oncogene BOOLEAN, tsg BOOLEAN")
    assert clean.filter_any_flag(df).count() == 2
    assert clean.filter_no_flag(df).count() == 1
    numbers = spark.createDataFrame([(None,), (1.0,), (0.0,)], "f DOUBLE")
    assert _rows(clean.numeric_flag_to_bool(numbers, ["f"]), "f") == [(False,), (False,), (True,)]


def test_member_lists(spark):
    texts = [("a,b",), ("b c",), (" d , e,",), ("",), (None,)]
    df = spark.createDataFrame(texts, "m STRING")
    assert [r[0] for r in _rows(clean.split_explode_members(df, "m"), "symbol")] == ["a", "b", "c", "d", "e"]


def test_labels_priority(spark):
    universe = spark.createDataFrame([("f",), ("both",)], "symbol STRING")
    shape = "symbol STRING, oncogene BOOLEAN, tsg BOOLEAN"
    canonical = spark.createDataFrame([("both", True, True), ("onc", True, False)], shape)
    candidate = spark.createDataFrame([("both", False, False), ("cand", False, False)], shape)
    out = {r.symbol: (r.label2, r.label3) for r in labels.assign_labels(universe, canonical, candidate).collect()}
    assert out == {"f": (0, 0), "both": (1, 1), "onc": (1, 2), "cand": (None, None)}


def test_tri_state_rejects_double_membership(spark):
    df = spark.createDataFrame([(True, True)], "d BOOLEAN, c BOOLEAN")
    assert labels.illegal_memberships(df, "d", "c").first()[0] == 1
    with pytest.raises(SparkRuntimeException):
        labels.tri_state_label(df, "d", "c").collect()


def test_alignment_rejects_repeated_keys(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "key STRING, x DOUBLE")
    two = spark.createDataFrame([("a", 1)], "key STRING, label INT")
    with pytest.raises(ValueError):
        labels.align_features_labels(one, two, "key")
    with pytest.raises(ValueError):
        readers.require_columns(one, ["absent"])


def test_dedupe_order(spark):
    df = spark.createDataFrame([("k", 1), ("k", 2), ("l", 3)], "key STRING, n INT")
    assert _rows(dedupe.dedupe_first(df, ["key"], ["n"]), "key", "n") == [("k", 1), ("l", 3)]
    assert _rows(dedupe.dedupe_last(df, ["key"], ["n"]), "key", "n") == [("k", 2), ("l", 3)]


def test_run_folder_names(spark):
    names = [("20251124_181841_x_default_binary",), ("20251124_181841_x_optimized_multiclass_smoteenn_less",), ("odd",)]
    df = spark.createDataFrame(names, "run STRING")
    parsed = [tuple(r) for r in df.select(parse_run_folder("run").alias("p")).select("p.task", "p.strategy", "p.reduced").collect()]
    assert parsed == [("binary", "none", False), ("multiclass", "smoteenn", True), (None, "none", False)]
    assert df.select(strategy_name("run")).first()[0] == "binary"


def test_readers_on_files(spark, tmp_path):
    (tmp_path / "banner.csv").write_text("checked on a day\nInput,Match type\nA,Unmatched\nB,Alias symbol\n")
    read = readers.read_banner_csv(spark, str(tmp_path / "banner.csv"), "input STRING, match_type STRING", ["Input", "Match type"])
    assert _rows(read, "input") == [("A",), ("B",)]
    (tmp_path / "positional.tsv").write_text("1\tABC\tsyn\n2\tA1\tsyn\n")
    assert readers.read_positional(spark, str(tmp_path / "positional.tsv"), 3).count() == 2
    (tmp_path / "headed.tsv").write_text("n\tsymbol_name\ts\n1\tABC\tsyn\n")
    assert readers.read_positional(spark, str(tmp_path / "headed.tsv"), 3, ["n", "symbol_name", "s"]).count() == 1
    parts = tmp_path / "parts"
    parts.mkdir()
    for k in range(3):
        (parts / f"{k}.tsv").write_text(f"{k}\tTP53\tx\n{k}\tNKX2-1\ty\n")
    assert readers.read_positional(spark, str(parts), 3).count() == 6
    (tmp_path / "net.json").write_text(
        '[{"nodes": [{"@id": 1, "n": "a", "r": ""}, {"@id": 7, "n": "b", "r": ""}]}, {"edges": [{"@id": 9, "s": 7, "t": 1}]}]'
    )
    nodes, edges = readers.read_network_json(spark, str(tmp_path / "net.json"))
    assert _rows(synonyms.resolve_edge_names(edges, nodes), "src", "dst") == [("b", "a")]


def test_one_network_file_in_many_splits(spark, tmp_path):
    names = ['plain', 'a } in "text"', 'back\\slash\\', '[{"nodes":[{', 'line\nbreak', 'é}{', '"', '}"}', "\\}"]
    nodes = [{"@id": i, "n": names[i % len(names)] + str(i), "r": "x"} for i in range(700)]
    edges = [{"@id": i, "s": i % 700, "t": i * 7 % 700, "v": {"deep": [{"w": "}"}]}} for i in range(1500)]
    container = [
        {"numberVerification": [{"longNumber": 281474976710655}]},
        {"nodes": nodes[:300]},
        {"edges": []},
        {"cyViews": [{"nodes": [{"@id": 5, "n": "not a node"}], "properties": {"edges": [{"s": 1, "t": 1}]}}]},
        {"edges": edges, "nodes": nodes[300:]},
        {"status": [{"error": "", "success": True}]},
    ]
    for indent in (None, 1):
        path = tmp_path / f"net{indent}.json"
        path.write_text(json.dumps(container, indent=indent, ensure_ascii=False))
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16kb")
        try:
            assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 4
            got_nodes, got_edges = readers.read_network_json(spark, str(path))
            assert sorted(map(tuple, got_nodes.collect())) == sorted((x["@id"], x["n"]) for x in nodes)
            assert sorted(map(tuple, got_edges.collect())) == sorted((x["s"], x["t"]) for x in edges)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "empty.json").write_text("[]")
    got_nodes, got_edges = readers.read_network_json(spark, str(tmp_path / "empty.json"))
    assert got_nodes.count() == 0 and got_edges.count() == 0


def test_prediction_file_priority(spark, tmp_path):
    folder = tmp_path / "20250101_000000_x_default_binary" / "k-nearest_neighbors"
    folder.mkdir(parents=True)
    text = '{"test_predictions": {"y_true": [%d], "y_pred": [0], "y_pred_proba": [[0.5, 0.5]]}}'
    (folder / "metrics.json").write_text(text % 1)
    (folder / "predictions.json").write_text(text % 0)
    out = readers.read_predictions(spark, str(tmp_path)).collect()
    assert [(r.model, r.y_true) for r in out] == [("k_nearest_neighbors", 0)]


def test_all_part_files_of_a_prediction_folder_are_read(spark, tmp_path):
    folder = tmp_path / "20250101_000000_x_default_binary" / "svc"
    folder.mkdir(parents=True)
    for k in range(2):
        (folder / f"part-{k}.json").write_text('{"test_predictions": {"y_true": [1, 0], "y_pred": [1, 0], "y_pred_proba": [[0.5, 0.5], [0.5, 0.5]]}}')
    assert readers.read_predictions(spark, str(tmp_path)).count() == 4


def test_written_predictions_are_read_back(spark, tmp_path):
    df = spark.createDataFrame(
        [("r", "svc", i, i % 2, 1 - i % 2, [0.25, 0.75]) for i in range(10)] + [("s", "catboost", 0, 1, None, [0.5, 0.5])],
        "run STRING, model STRING, position INT, y_true INT, y_pred INT, proba ARRAY<DOUBLE>",
    )
    writers.write_predictions_json(df, str(tmp_path / "out"))
    back = readers.read_predictions(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_prediction_files_are_parsed_once(spark, tmp_path):
    """Choosing the best name of a folder and reading its examples share one pass over the files."""
    folder = tmp_path / "run" / "catboost"
    folder.mkdir(parents=True)
    (folder / "predictions.json").write_text('{"test_predictions": {"y_true": [1, 0], "y_pred": [1, 1], "y_pred_proba": [[0.2, 0.8], [0.4, 0.6]]}}')
    out = readers.read_predictions(spark, str(tmp_path))
    assert all("/run/catboost/" not in f for f in out.inputFiles())
    assert sorted((r.run, r.model, r.position, r.y_true) for r in out.collect()) == [("run", "catboost", 0, 1), ("run", "catboost", 1, 0)]


def test_prediction_files_in_the_run_folder_stand_in_for_absent_models(spark, tmp_path):
    run = tmp_path / "20250101_000000_x_optimized_binary"
    (run / "svc").mkdir(parents=True)
    text = '{"test_predictions": {"y_true": [%d], "y_pred": [0], "y_pred_proba": [[0.5, 0.5]]}}'
    (run / "svc" / "metrics.json").write_text(text % 1)
    (run / "nested_cv_svc_20250101.json").write_text(text % 0)
    (run / "nested_cv_random_forest_20250101.json").write_text(text % 0)
    out = readers.read_predictions(spark, str(tmp_path)).collect()
    assert sorted((r.run, r.model, r.y_true) for r in out) == [(run.name, "random_forest", 0), (run.name, "svc", 1)]


def test_unlabeled_rows_survive_splits_and_weights(spark):
    from labelweave.operators import splits

    df = spark.range(100).selectExpr("id AS key", "CASE WHEN id % 4 = 0 THEN NULL ELSE id % 4 END AS label")
    assert splits.stratified_kfold(df, "key", "label").filter("fold IS NOT NULL").count() == 100
    assert splits.stratified_holdout(df, "key", "label").count() == 100
    assert splits.balanced_class_weights(df, "label").filter("label IS NULL AND weight = 1.0").count() == 25


def test_write_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", True), ("a", None)], "symbol STRING, oncogene BOOLEAN")
    writers.write_tsv(df, str(tmp_path / "out"), order=["symbol"])
    back = readers.read_delimited(spark, str(tmp_path / "out"), "symbol STRING, oncogene STRING")
    assert _rows(back, "symbol", "oncogene") == [("a", "No"), ("b", "Yes")]


def test_feature_groups_and_fill(spark):
    df = spark.createDataFrame([("k", [float(i) for i in range(64)])], "key STRING, x ARRAY<DOUBLE>")
    assert clean.select_feature_group(df, "x", "Mutations").first().x == [float(i) for i in range(48, 64)]
    with pytest.raises(ValueError):
        clean.select_feature_group(df, "x", "absent")
    holes = spark.createDataFrame([("k", [1.0, None])], "key STRING, x ARRAY<DOUBLE>")
    assert clean.fill_missing(holes, "x").select(F.col("x")).first().x == [1.0, 0.0]


def test_container_shuffles_only_the_ends_of_splits(spark, tmp_path, monkeypatch):
    names = ['a } b', '[x] "q"', "{", "plain", '] "nodes": [{']
    nodes = [{"@id": i, "n": names[i % len(names)], "r": {"p": [1, {"q": "}"}]}} for i in range(300)]
    container = [{"status": [{"success": True}]}, {"nodes": nodes[:170]}, {"edges": [{"s": i, "t": i + 1} for i in range(200)]}, {"nodes": []}, {"nodes": nodes[170:]}]
    (tmp_path / "net.json").write_text(json.dumps(container, indent=1))
    staged = []
    monkeypatch.setattr(readers, "stage", lambda df, name="stage", **more: staged.append(df.count()) or stage(df, name, **more))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got_nodes, got_edges = readers.read_network_json(spark, str(tmp_path / "net.json"))
        assert sorted(tuple(r) for r in got_nodes.collect()) == [(n["@id"], n["n"]) for n in nodes]
        assert sorted(tuple(r) for r in got_edges.collect()) == [(i, i + 1) for i in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # one or two elements of every split, of 500 in all
    assert max(staged) <= 2 * (-(-(tmp_path / "net.json").stat().st_size // 4000) + 1) < 100
