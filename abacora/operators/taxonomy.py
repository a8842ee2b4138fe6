"""Failure modes of scored outputs and grouped reports of them (TAX1-2, AGG4, AGG15, AGG17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import similarity as S
from ..functions.text import let
from .score import type_or_unknown


#: Outputs of up to so many words are no repetition loops.
LOOP_WORDS = 10


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(P.WORD))


def failures(output: Column, extractable: Column, score: Column, pred: Column, gold: Column, trigrams: Column | None = None, extended: bool = False) -> Column:
    """TAX1: labels in their fixed order. extended adds truncation_failure and bilingual_leakage."""
    if trigrams is None:
        trigrams = F.when(words(output) > LOOP_WORDS, S.max_trigram_count(output))  # looked at in longer outputs only
    given = F.struct(words(output).alias("n"), extractable.alias("ok"), score.alias("score"), pred.cast("double").alias("pred"), gold.cast("double").alias("gold"), trigrams.alias("tri"), output.alias("out"))
    return let(given, lambda g: _labels(g["out"], g["n"], g["ok"], g["score"], g["pred"], g["gold"], g["tri"], extended))


def _labels(output: Column, n: Column, extractable: Column, score: Column, pred: Column, gold: Column, trigrams: Column, extended: bool) -> Column:
    zero = score == 0
    wrong = F.coalesce(extractable & zero, F.lit(False))
    both = pred.isNotNull() & gold.isNotNull()
    sign = both & (pred == -gold) & (gold != 0)
    ratio = F.abs(pred / F.nullif(gold, F.lit(0.0)))
    power = F.log10(F.when((ratio > 0) & (ratio < float("inf")), ratio))
    shifted = both & (gold != 0) & (pred != 0) & F.coalesce(F.abs(power - F.rint(power)) < 1e-4, F.lit(False))
    early = (n <= 4) & zero
    label = lambda c, name: F.when(c, F.lit(name))
    loops = (n > LOOP_WORDS) & (trigrams > 4)
    found = [label(~F.coalesce(extractable, F.lit(False)), "extraction_failure"), label(early, "premature_eos")]
    if extended:
        found.append(label(~early & (n >= 195), "truncation_failure"))
    found += [
        label(loops, "repetition_loop"), label(wrong & sign, "operator_sign_mistake"), label(wrong & ~F.coalesce(sign, F.lit(False)) & shifted, "decimal_placement_error"),
        label(wrong & both & ~sign & ~shifted, "arithmetic_mistake"), label(wrong & ~both, "formatting_drift"),
    ]
    if extended:
        found.append(label(F.regexp_count(output, F.lit(r"(?i)\b(?:the|answer|is|let|hence|therefore|step|solution)\b")) >= 2, "bilingual_leakage"))
    some = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, some).when(score < 10, F.array(F.lit("reasoning_collapse"))).otherwise(F.array(F.lit("clean_pass")))


def diagnostic_frame(rows: DataFrame, output: str = "model_output", extended: bool = True) -> DataFrame:
    """TAX2."""
    o = F.col(output)
    out = rows.withColumn("failures", failures(o, F.col("extractable"), F.col("score"), F.col("pred_num"), F.col("gold_num"), extended=extended))
    out = out.withColumn("words", words(o)).withColumn("chars", F.length(o)).withColumn("math_ops", F.regexp_count(o, F.lit(r"[+\-*/=]|\\frac")))
    return out.withColumn("math_density", F.col("math_ops") / F.greatest(F.col("words"), F.lit(1))).withColumn("token_estimate", F.col("words") * 1.3).withColumn("primary_failure", F.element_at("failures", 1))


def failure_counts(framed: DataFrame) -> DataFrame:
    """AGG4: occurrences and mean score by label."""
    # explode would make Catalyst copy the labels' definition into filters on their size and nullness, so they would be worked out three times.
    return framed.select(F.explode_outer("failures").alias("failure"), "score").filter("failure is not null").groupBy("failure").agg(F.count("*").alias("occurrences"), F.avg("score").alias("mean_score"))


def type_performance(framed: DataFrame) -> DataFrame:
    return framed.groupBy(type_or_unknown().alias("type")).agg(F.count("*").alias("count"), F.avg("score").alias("mean_score"))


def diagnostic_class() -> Column:
    """AGG8's classes of a scored row."""
    return F.when(F.col("score") == 10, "good").when(F.col("score") > 0, "partial").when(~F.col("extractable"), "extraction_failure").when(F.col("pred_num").isNull(), "parse_failure").otherwise("wrong_answer")


def error_analysis(rows: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """AGG15: zero scores by type (most first) and the first examples of each class."""
    by_type = rows.groupBy(type_or_unknown().alias("type")).agg(F.count("*").alias("n"), F.count_if(F.col("score") == 0).alias("score0")).orderBy(F.desc("score0"), "type")
    w = Window.partitionBy("class").orderBy("row_idx")
    return by_type, rows.withColumn("class", diagnostic_class()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def rollout_stats(rewards: DataFrame, group: str, reward: str) -> DataFrame:
    """AGG17: mean reward, and the share of groups all of whose rewards are equal."""
    per = rewards.groupBy(group).agg(F.avg(reward).alias("mean"), F.sum(reward).alias("total"), F.count("*").alias("n"), F.stddev_pop(reward).alias("std"))
    return per.agg(F.count("*").alias("groups"), F.sum("n").alias("rollouts"), (F.sum("total") / F.sum("n")).alias("reward_mean"), F.avg((F.col("std") <= 1e-8).cast("double")).alias("no_signal_group_rate"))
