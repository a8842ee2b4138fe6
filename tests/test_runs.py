"""Run folders with and without their optional files, and the choice between ids and positions."""

import json

import pytest

from abacora.operators import align, runs


def write(folder, **members):
    folder.mkdir(parents=True)
    for name, value in members.items():
        (folder / f"{name}.json").write_text(json.dumps(value))


def test_folders_with_optional_files(spark, tmp_path):
    rows = [
        {"id": 1, "type": "A", "score": 10, "extractable": True, "gold_num": 1, "pred_num": 1}, {"id": 0, "type": None, "score": 0, "extractable": True, "gold_num": 1, "pred_num": None},
        {"id": "x", "type": "A", "score": 0, "extractable": False}, {"id": 7, "type": "A", "score": 5, "extractable": True, "gold_num": 2, "pred_num": 3}, {"id": 2, "type": "B", "score": 0, "extractable": True, "gold_num": 2, "pred_num": 3},
    ]
    outputs = [{"model_output": "first", "query_vi": "q" * 600}, {"model_output": 'Đáp án là: "5'}, {"model_output": "w " * 50}]
    summary = {"n": 5, "total_score": 15, "score_10": 3.0, "buckets": {"10": 1, "5": 1, "0": 3}, "extractable": 4, "numeric_pairs": 3}
    write(tmp_path / "b_full", valid_report={"summary": summary, "rows": rows}, valid_output=outputs, experiment_report={"config": {"a": "1"}, "training": {"wall_time_minutes": 2.5}, "preflight_passed": True}, run_config={"a": "9", "b": "2"}, run_status={"state": "done"})
    write(tmp_path / "a_bare", valid_report={"summary": {"n": 0}, "rows": []})
    write(tmp_path / "c_none", run_config={"a": "1"})
    write(tmp_path / "b_full" / "deeper", valid_report={"summary": {"n": 99}})
    folders = runs.scan_folders(spark, str(tmp_path))
    m = {r["name"]: r for r in runs.run_metrics(folders).collect()}
    assert set(m) == {"a_bare", "b_full"}
    full = m["b_full"]
    assert (full["n"], full["raw_score"], full["bucket_10_rate"], full["partial_count"], full["runtime_minutes"], full["preflight_passed"]) == (5, 15, 0.2, 1, 2.5, True)
    assert full["config"] == {"a": "1", "b": "2"} and full["status"] == {"state": "done"} and full["path"].endswith("/b_full")
    assert (m["a_bare"]["n"], m["a_bare"]["bucket_10_rate"], m["a_bare"]["config"], m["a_bare"]["status"]) == (0, 0.0, {}, None)
    classed = runs.with_classes(runs.run_rows(folders))
    got = {r["row_idx"]: r["classes"] for r in classed.collect()}
    assert got == {0: ["good", "quoted_answer"], 1: ["extractable_not_numeric"], 2: ["non_extractable"], 3: ["partial"], 4: ["extractable_wrong", "repetitive"]}
    counts = runs.class_counts(classed).first()
    assert (counts["rows"], counts["good_count"], counts["repetitive_count"]) == (5, 1, 1)
    assert {(r["type"], r["n"], r["score0"], r["non_extractable"], r["bad_parse"]) for r in runs.failures_by_type(classed).collect()} == {("A", 3, 1, 1, 0), ("unknown", 1, 1, 0, 1), ("B", 1, 1, 0, 0)}
    examples = runs.class_examples(classed, most=1).collect()
    assert len(examples) == 7 and max(len(r["query_vi"]) for r in examples) == 500


def test_ids_or_positions(spark):
    gold = spark.createDataFrame([("1", 0, 5.0), ("2", 1, 6.0)], "id string, row_idx long, gold double")
    pred = spark.createDataFrame([("2", 0, 1.0), ("1", 1, 2.0)], "id string, row_idx long, pred double")
    run = lambda p, g: sorted((r["row_idx"], r["gold"], r["pred"]) for r in align.align(p, g, ["pred"], ["gold"]).collect())
    assert run(pred, gold) == [(0, 5.0, 2.0), (1, 6.0, 1.0)]
    assert run(pred.drop("id"), gold) == [(0, 5.0, 1.0), (1, 6.0, 2.0)]
    some = spark.createDataFrame([("2", 0, 1.0), (None, 1, 2.0)], "id string, row_idx long, pred double")
    assert run(some, gold) == [(0, 5.0, 1.0), (1, 6.0, 2.0)]
    with pytest.raises(align.MissingPredictions):
        align.align(pred.filter("id = '1'"), gold, ["pred"], ["gold"])
    with pytest.raises(ValueError, match="count"):
        align.align(some.limit(1).drop("id"), gold, ["pred"], ["gold"])
