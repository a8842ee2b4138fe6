"""Costly columns once for equal values: the same rows, and how many rows the costly part gets."""

import pytest
from pyspark.sql import functions as F

from abacora.operators import once, targets
from abacora.plans import target_queries

ADD, UNKNOWN = "Ta có 5 + 7 = 12 quả. Đáp án là: 12", "Ta có x + 2 = 14, suy ra x = 12. Đáp án là: 12"


@pytest.mark.parametrize("copies", [1, 9])
def test_rows_equal_those_of_the_plain_way(spark, copies):
    values = [("GSM_AnsAug", ADD), ("GSM_SV", UNKNOWN), ("MATH_AnsAug", ADD), (None, ADD), ("X", None), (None, None), ("X", "")]
    rows = spark.createDataFrame([(i % 5, *v) for i, v in enumerate(values * copies)], "i int, type string, response_vi string")
    asked = []

    def make(t):
        asked.append(t.count())
        return targets.build(t, "type_specific_equation_targets")

    got, plain = once.per_value(rows, ["response_vi", "type"], make), targets.build(rows, "type_specific_equation_targets")
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert asked == [len(values)]


@pytest.mark.parametrize("query", ["target_styles", "target_programs", "minimal_reasonings"])
def test_targets_of_lines_are_worked_out_once_a_text(spark, tmp_path, monkeypatch, query):
    spark.range(3000).select((F.col("id") / 7).cast("long").alias("l_orderkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 3).cast("double").alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    asked = []
    per_value = once.per_value

    def seen(rows, by, make):
        return per_value(rows, by, lambda t: asked.append(t.count()) or make(t))

    monkeypatch.setattr(once, "per_value", seen)
    assert target_queries.QUERIES[query](spark, str(tmp_path)).count() == 3000
    assert asked and asked[0] <= 21
