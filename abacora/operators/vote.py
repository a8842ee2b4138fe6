"""Voting over candidate completions (VOT1-4, ANS5, SET3, AGG18, TGT9). Candidates: record_id, sample_idx, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers, numeric
from ..functions.text import clean_model_output
from .scratch import stored


def candidate_bank(*tables: DataFrame) -> DataFrame:
    """SET3: all candidates of several checkpoints; sample_idx must be distinct within a record."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def parsed(candidates: DataFrame) -> DataFrame:
    c = candidates.withColumn("cleaned", clean_model_output(F.coalesce("text", F.lit(""))))
    c = c.withColumn("answer", answers.extract_pred(F.col("cleaned")))
    return c.withColumn("number", F.round(numeric.parse_number(F.col("answer")), 4))


def vote(parsed_candidates: DataFrame) -> DataFrame:
    """VOT1 over parsed() rows: record_id, chosen, answer, vote_count, reason. All values with the most votes stand; the shortest text wins, then the first.

    Two grouped passes (votes per value, then the choice), both combined on the map side; no list of candidates is gathered.
    """
    order = F.struct(F.length("cleaned").alias("n"), F.col("sample_idx"))
    per = parsed_candidates.groupBy("record_id", "number").agg(F.count("*").alias("votes"), F.min_by(F.struct("cleaned", "answer"), order).alias("best"), F.min(order).alias("place"))
    known = F.col("number").isNotNull()
    rank = F.struct(known.cast("int").alias("k"), F.when(known, F.col("votes")).otherwise(0).alias("v"), (-F.col("place.n")).alias("n"), (-F.col("place.sample_idx")).alias("i"))
    out = per.groupBy("record_id").agg(F.max_by(F.struct("number", "votes", "best"), rank).alias("w"))
    known = F.col("w.number").isNotNull()
    text = F.col("w.best.cleaned")
    chosen = F.when(known & ~F.contains(text, F.lit("####")), F.concat(F.lit("####đáp án là: "), F.col("w.best.answer"))).otherwise(text)
    reason = F.when(~known, "no_parseable_answer").when(F.col("w.votes") > 1, "numeric_majority").otherwise("single_parseable_answer")
    return out.select("record_id", chosen.alias("chosen"), F.when(known, F.col("w.best.answer")).alias("answer"), F.when(known, F.col("w.number")).alias("vote_key"), F.when(known, F.col("w.votes")).otherwise(0).alias("vote_count"), reason.alias("reason"))


def vote_candidate_texts(candidates: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """VOT1; records (record_id) without candidates are told as empty_candidates."""
    out = vote(parsed(candidates))
    if records is None:
        return out
    full = records.select("record_id").join(out, "record_id", "left")
    return full.withColumn("reason", F.coalesce("reason", F.lit("empty_candidates"))).fillna({"chosen": "", "vote_count": 0})


def self_consistency(candidates: DataFrame) -> DataFrame:
    """VOT2: the value met most often (first met on a tie), its shortest text; without any value the shortest text."""
    c = candidates.withColumn("number", F.round(numeric.parse_number(F.nullif(answers.answer_for_voting(F.col("text")), F.lit("NONE"))), 4))
    order = F.struct(F.length("text").alias("n"), F.col("sample_idx"))
    per = c.groupBy("record_id", "number").agg(F.count("*").alias("votes"), F.min("sample_idx").alias("met"), F.min_by("text", order).alias("text"))
    rank = F.struct(F.col("number").isNotNull().cast("int"), F.col("votes"), -F.col("met"))
    return per.groupBy("record_id").agg(F.max_by("text", rank).alias("chosen"))


def voted_string(candidates: DataFrame, answer: str = "answer") -> DataFrame:
    """VOT3: an answer string met at least twice, else the first candidate's."""
    per = candidates.groupBy("record_id", F.col(answer).alias("a")).agg(F.count("*").alias("votes"), F.min("sample_idx").alias("met"))
    rank = F.struct(F.when(F.col("a").isNotNull() & (F.col("votes") >= 2), F.col("votes")).otherwise(0), -F.col("met"))
    return per.groupBy("record_id").agg(F.max_by("a", rank).alias("chosen"))


def reason_histogram(voted: DataFrame) -> DataFrame:
    return voted.groupBy("reason").agg(F.count("*").alias("n"))


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """AGG18: how many records have how many candidates."""
    return candidates.groupBy("record_id").agg(F.count("*").alias("candidates")).groupBy("candidates").agg(F.count("*").alias("records"))


def self_distilled(scored: DataFrame, most: float = 0.01, longest: int = 420) -> DataFrame:
    """TGT9: of each record's right candidates the shortest (then smallest) text; a longer one than `longest` is cut to its answer."""
    best = scored.filter(F.col("rel_error") <= most).groupBy("record_id").agg(F.min(F.struct(F.length("text").alias("n"), F.col("text"), F.col("answer"))).alias("b"))
    return best.select("record_id", F.when(F.col("b.n") > longest, F.concat(F.lit("####đáp án là: "), F.col("b.answer"))).otherwise(F.col("b.text")).alias("target"))


def group_advantage(rewards: DataFrame, group: str, reward: str) -> DataFrame:
    """WIN4: reward less the group's mean, over its deviation; 0 where all are equal. By a grouped join, so a large group is no single task."""
    stats = rewards.groupBy(F.col(group).alias("_g")).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_std"))
    out = rewards.join(stats, rewards[group] == F.col("_g"))
    return out.withColumn("advantage", F.when(F.col("_std") <= 1e-8, 0.0).otherwise((F.col(reward) - F.col("_mean")) / (F.col("_std") + 1e-8))).drop("_g", "_mean", "_std")


def last_before(rows: DataFrame, key: str, order: list[str], value: str, alias: str) -> DataFrame:
    """WIN5: the last known value before each row of its key; order must tell a key's rows apart.

    A segmented scan: rows are written once as sorted ranges of key and order, so a key with many rows lies in many blocks. Each block
    scans its own rows; the last known values of the blocks of a key, one row per block, are carried on, and fill what
    a block's first rows cannot see. No task holds more of a key than a block.
    """
    blocks = stored(rows.repartitionByRange(key, *order).withColumn("_block", F.spark_partition_id()), "scan")
    by = F.struct(*order)
    inside = Window.partitionBy("_block", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.col(value).isNotNull()
    ends = blocks.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_of")).agg(F.max_by(F.when(known, F.col(value)), F.when(known, by)).alias("_end"))
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)))
    # A block's rows meet one row of its key, null keys one of theirs.
    on = (F.col("_block") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key"))
    local = blocks.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    return local.join(carried.select("_key", "_of", "_carry"), on, "left").select(*rows.columns, F.coalesce("_local", "_carry").alias(alias))
