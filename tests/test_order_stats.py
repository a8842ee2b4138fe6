"""Distributed selection against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacora.operators import audit, order_stats

SHARES = (0, 0.1, 0.25, 0.5, 0.9, 0.99, 1)


def quantile(values, share):
    at = share * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    return values[low] if low == high else (high - at) * values[low] + (at - low) * values[high]


@pytest.mark.parametrize("bins", [2, 4096])
def test_quantiles_by_group_with_ties_outliers_nulls_and_one_value(spark, monkeypatch, bins):
    monkeypatch.setattr(order_stats, "BINS", bins)
    rng = random.Random(bins)
    groups = {
        "even": [rng.random() for _ in range(400)], "ties": [float(rng.randrange(4)) for _ in range(500)], "one": [7.5], "same": [3.0] * 200, "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(300)],
        "outlier": [1e308, -1e308, *[float(i) for i in range(50)]], None: [1.0, 2.0], "signs": [0.0, -0.5, 0.5, -1e-9],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("even", None), ("empty", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = order_stats.quantiles(order_stats.value_counts(df, F.col("x"), ["g"]), SHARES, ["g"]).collect()
    assert {r["g"] for r in got} == set(groups)
    for r in got:
        assert list(r)[1:] == pytest.approx([quantile(sorted(groups[r["g"]]), s) for s in SHARES], rel=1e-12, abs=1e-300)


def test_infinities_come_at_the_ends(spark):
    values = [float("-inf"), -2.0, 5.0, float("inf"), float("inf")]
    counts = order_stats.value_counts(spark.createDataFrame([(v,) for v in values], "x double"), F.col("x"))
    assert {r["rank"]: r["value"] for r in order_stats.at_ranks(counts, F.sequence(F.lit(0), F.col("n") - 1)).collect()} == dict(enumerate(values))
    assert order_stats.at_ranks(counts.limit(0), F.array(F.lit(0).cast("long"))).count() == 0


def test_no_percentile_in_plans_and_few_rows_sorted(spark):
    df = spark.range(20000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7).alias("x"), F.lit("a").alias("lang"), F.col("id").cast("string").alias("text"))
    plan = audit.with_quantiles(df.agg(F.count("*").alias("n")), df, F.col("x"), (50, 90))._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()
    got = audit.with_quantiles(df.agg(F.count("*").alias("n")), df, F.col("x"), (50, 90)).first()
    xs = np.sort([r["x"] for r in df.select("x").collect()])
    assert (got["n"], got["p50"], got["p90"]) == (20000, pytest.approx(np.quantile(xs, 0.5)), pytest.approx(np.quantile(xs, 0.9)))
