"""Scores of predictions against gold: per row, by type and in all (SCR1-4, AGG1-3, AGG20-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, numeric
from . import order_stats

BUCKETS = (10, 5, 1, 0)


def rel_error(pred: Column, gold: Column) -> Column:
    return F.when(pred.isNotNull() & gold.isNotNull(), F.abs(pred - gold) / F.greatest(F.lit(1.0), F.abs(gold)))


def score_one(error: Column, extractable: Column) -> Column:
    return F.when(~extractable | error.isNull(), 0).when(error <= 0.01, 10).when(error <= 0.10, 5).when(error <= 0.50, 1).otherwise(0)


def score_rows(pairs: DataFrame, response: str = "response_vi", output: str = "model_output") -> DataFrame:
    """Scored rows of aligned pairs; columns that are there already stay."""
    out = pairs.withColumn("gold_answer", answers.extract_gold(F.col(response))).withColumn("pred_answer", answers.extract_pred(F.col(output)))
    out = out.withColumn("gold_num", numeric.parse_number(F.col("gold_answer"))).withColumn("pred_num", numeric.parse_number(F.col("pred_answer")))
    return with_score(out.withColumn("extractable", F.col("pred_answer").isNotNull()))


def with_score(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("rel_error", rel_error(F.col("pred_num"), F.col("gold_num")))
    return out.withColumn("score", score_one(F.col("rel_error"), F.col("extractable")))


def type_or_unknown(c: str = "type") -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("UNKNOWN"))


def _sums() -> list[Column]:
    score = F.coalesce("score", F.lit(0))
    numeric_pair = F.col("gold_num").isNotNull() & F.col("pred_num").isNotNull()
    return [
        F.count("*").alias("n"), F.coalesce(F.sum(score), F.lit(0)).cast("long").alias("raw_score"), F.count_if(score == 10).alias("exact_count"), F.count_if("extractable").alias("extractable"), F.count_if(numeric_pair).alias("numeric_pairs"),
        *[F.count_if(score == b).alias(f"bucket_{b}") for b in BUCKETS],
    ]


def _share(c: str, of: Column) -> Column:
    return F.coalesce(F.try_divide(F.col(c).cast("double"), of), F.lit(0.0))


def score_by_type(rows: DataFrame) -> DataFrame:
    """AGG3."""
    n = F.col("n")
    out = rows.groupBy(type_or_unknown().alias("type")).agg(*_sums())
    return out.select("*", _share("raw_score", n).alias("mean_score"), _share("raw_score", 10 * n).alias("score_pct"), _share("extractable", n).alias("extractable_rate"), _share("numeric_pairs", n).alias("numeric_pair_rate"))


def diagnostics(rows: DataFrame, error: str = "rel_error") -> DataFrame:
    """AGG2: one row; quantiles are exact and interpolated. No rows if no error is known.

    All of it reads the counts of distinct errors, which are shuffled once; worst_5 is a bounded top list.
    """
    counts = order_stats.value_counts(rows, F.col(error))
    names = ("median_rel_error", "p90_rel_error", "p95_rel_error", "p99_rel_error")
    at = order_stats.quantiles(counts, (0.5, 0.9, 0.95, 0.99), names=names)
    mean = lambda x: F.sum(x * F.col("c")) / F.sum("c")
    first = counts.agg(F.sum("c").alias("n_with_error"), mean(F.col("x")).alias("mean_rel_error")).filter("n_with_error > 0")
    capped = counts.crossJoin(F.broadcast(at.select((F.col("median_rel_error") * 10).alias("cap")))).agg(mean(F.least("x", "cap")).alias("capped_mean_rel_error"))
    top = counts.orderBy(F.desc("x")).limit(5).select("x", F.explode(F.array_repeat("x", F.least("c", F.lit(5)).cast("int"))))
    worst = top.orderBy(F.desc("x")).limit(5).agg(F.sort_array(F.collect_list("x"), asc=False).alias("worst_5_errors"))
    # One row each.
    return first.crossJoin(F.broadcast(at)).crossJoin(F.broadcast(capped)).crossJoin(F.broadcast(worst)).select("n_with_error", "mean_rel_error", *names, "capped_mean_rel_error", "worst_5_errors")


def summary(rows: DataFrame) -> DataFrame:
    """AGG1's head: one row also for no rows."""
    n = F.col("n")
    out = rows.agg(*_sums(), F.avg("rel_error").alias("rel_error_mean"))
    return out.select("*", (10 * n).alias("max_raw_score"), _share("raw_score", n).alias("score_10"), _share("raw_score", 10 * n).alias("score_pct"))


def reward_grpo(error: Column, formatted: Column) -> Column:
    """SCR3: correctness 1, .25 or .05, and .05 for the format."""
    return F.when(error.isNull(), 0.0).when(error <= 0.01, 1.0).when(error <= 0.10, 0.25).when(error <= 0.50, 0.05).otherwise(0.0) + F.when(formatted, 0.05).otherwise(0.0)


def reward_weighted(error: Column, tags_ok: Column, partial: bool = True, weights: tuple[float, float] = (0.95, 0.05)) -> Column:
    """SCR3, weighted form: correctness 1, .5 or .1 (the last two if partial counts) and a format reward of 1 or -.5."""
    right = F.when(error.isNull(), 0.0).when(error <= 0.01, 1.0)
    if partial:
        right = right.when(error <= 0.10, 0.5).when(error <= 0.50, 0.1)
    return weights[0] * right.otherwise(0.0) + weights[1] * F.when(tags_ok, 1.0).otherwise(-0.5)


def preflight(stats: DataFrame) -> DataFrame:
    """SCR4: fail reasons of one row of rates (exact_rate, correctness_mean, tagged_rate)."""
    reasons = F.concat_ws("; ", F.when(F.col("exact_rate") <= 0, "exact=0"), F.when(F.col("correctness_mean") <= 0, "correctness=0"), F.when(F.col("tagged_rate") < 0.60, "tagged_rate<0.60"))
    return stats.withColumn("fail_reasons", reasons).withColumn("passed", F.col("fail_reasons") == "")


def fallback_gain(rows: DataFrame, output: str = "model_output") -> DataFrame:
    """AGG21: points that the last number of a text would bring to rows without any."""
    value = numeric.parse_plain(answers.last_number(F.col(output)))
    gain = score_one(rel_error(value, F.col("gold_num")), value.isNotNull())
    return rows.filter("score = 0").agg(F.count("*").alias("zero_rows"), F.count_if(gain > 0).alias("recovered_rows"), F.coalesce(F.sum(gain), F.lit(0)).cast("long").alias("recovered_points"))
