"""Partitions in which orders are sorted with their texts don't grow with the table."""

from pyspark.sql import functions as F

from abacora.plans import curation_queries


def test_self_distilled_sorts_in_more_partitions_for_more_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(curation_queries, "LINES_A_TASK", 500, raising=False)
    lines = spark.range(10_000).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), (F.col("id") % 50).cast("double").alias("l_quantity"), F.lit(0.01).alias("l_discount"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = curation_queries.self_distilled(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() == 20
        assert out.count() == 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
