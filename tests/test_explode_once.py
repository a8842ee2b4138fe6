"""Costly label arrays are worked out once a row: no filter below the explode repeats their definition."""

from pyspark.sql import functions as F

from abacora.operators import runs, score, taxonomy


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_failure_counts_work_out_labels_once_and_only_longer_outputs_are_searched_for_loops(spark):
    rows = spark.createDataFrame([("a", 4.0, 4.0, True, "a b c " * 8), ("a", 4.0, 4.0, True, "no"), ("b", 4.0, None, False, None), ("b", 4.0, -4.0, True, "five words are in this")], "type string, gold_num double, pred_num double, extractable boolean, model_output string")
    out = taxonomy.failure_counts(taxonomy.diagnostic_frame(score.with_score(rows), extended=False))
    assert {(r["failure"], r["occurrences"]) for r in out.collect()} == {("repetition_loop", 1), ("clean_pass", 1), ("extraction_failure", 1), ("premature_eos", 1), ("operator_sign_mistake", 1)}
    assert plan(out).count("operator_sign_mistake") <= plan(taxonomy.diagnostic_frame(score.with_score(rows), extended=False).select("failures")).count("operator_sign_mistake")


def test_class_examples_work_out_classes_once_and_leave_out_rows_without_a_class(spark):
    rows = spark.createDataFrame([("r", 1, 10, True, 1.0, 1.0, "x"), ("r", 2, 7, True, 1.0, 1.0, "x")], "name string, row_idx long, score int, extractable boolean, gold_num double, pred_num double, model_output string")
    out = runs.class_examples(runs.with_classes(rows))
    assert [(r["class"], r["row_idx"]) for r in out.collect()] == [("good", 1)]
    assert plan(out).count("extractable_not_numeric") <= plan(runs.with_classes(rows).select("classes")).count("extractable_not_numeric")
