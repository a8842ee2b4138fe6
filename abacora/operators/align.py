"""Alignment of predictions with gold, resume joins and lookups by position (JOIN1-5, JOIN8-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored


class MissingPredictions(ValueError):
    """Gold records without a prediction."""


def align_by_id(pred: DataFrame, gold: DataFrame, pred_cols: list[str], gold_cols: list[str], check: bool = True) -> DataFrame:
    """JOIN1: every gold row with the last prediction (largest row_idx) of its id; missing ids raise, or with check=False their rows are left out (the caller then knows that some are missing)."""
    one = pred.groupBy(F.col("id").cast("string").alias("_id")).agg(F.max_by(F.struct(*[F.col(c) for c in pred_cols]), "row_idx").alias("_p"))
    left = gold.select(F.col("id").cast("string").alias("id"), *gold_cols)
    if check:
        lost = left.join(one, left["id"] == F.col("_id"), "left_anti")
        first = [r["id"] for r in lost.select("id").limit(5).collect()]
        if first:
            raise MissingPredictions(f"Predictions missing {lost.count()} ids, e.g. {first}")
    return left.join(one, left["id"] == F.col("_id")).select("id", *gold_cols, *[F.col(f"_p.{c}").alias(c) for c in pred_cols])


def align(pred: DataFrame, gold: DataFrame, pred_cols: list[str], gold_cols: list[str]) -> DataFrame:
    """JOIN1: by id if both tables have an id on every row, else by row_idx; missing ids, or different counts, raise. Columns id and row_idx of gold stay.

    Whether ids are there is counted in one pass over each table.
    """
    told = [F.col("id").isNotNull() if "id" in t.columns else F.lit(False) for t in (pred, gold)]
    whole = [not t.filter(~has).limit(1).count() for t, has in zip((pred, gold), told)]
    if all(whole):
        return align_by_id(pred, gold, pred_cols, ["row_idx", *gold_cols])
    has_id = "id" in gold.columns
    left = gold.select((F.col("id").cast("string") if has_id else F.lit(None).cast("string")).alias("id"), "row_idx", *gold_cols)
    return align_by_position(pred.select("row_idx", *pred_cols), left, check=True).select("id", "row_idx", *gold_cols, *pred_cols)


def align_by_position(pred: DataFrame, gold: DataFrame, check: bool = False, how: str = "inner") -> DataFrame:
    """JOIN2 and JOIN3: by row_idx; with check, different counts raise."""
    if check and (n := pred.count()) != (m := gold.count()):
        raise ValueError(f"Prediction count {n} != gold count {m}")
    return gold.join(pred, "row_idx", how)


def resume(inputs: DataFrame, done: DataFrame, key: str = "source_hash") -> DataFrame:
    """JOIN5: inputs whose key is not among the finished ones."""
    return inputs.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def source_hash(*parts):
    return F.sha2(F.concat_ws("\n", *parts), 256)


def with_losses(epochs: DataFrame, losses: DataFrame, best_max: int | None = None) -> DataFrame:
    """JOIN4: epoch scores with their losses, the gap of both losses and, given a maximum, the score's share of it."""
    out = epochs.join(losses, "epoch", "left").withColumn("loss_gap", F.col("validation_loss") - F.col("training_loss"))
    return out if best_max is None else out.withColumn("score_pct", F.col("raw_score") / max(1, best_max))


def with_row_idx(df: DataFrame, *order: str) -> DataFrame:
    """row_idx by the order of columns without one global window: sorted ranges are written once, numbered and shifted by the counts before them."""
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    spread = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", number), "ranges")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    # One row per written range.
    return spread.join(F.broadcast(before), "_part").withColumn("row_idx", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def lookup_by_position(rows: DataFrame, pred: DataFrame, id_: str = "id") -> DataFrame:
    """JOIN8: every row with the prediction at the position that its id names; null columns where there is none."""
    at = pred.withColumnRenamed("row_idx", "position")
    return rows.join(at, F.expr(f"try_cast(`{id_}` AS bigint)") == F.col("position"), "left").drop("position")


def with_examples(failures: DataFrame, pred: DataFrame, gold: DataFrame) -> DataFrame:
    """JOIN9: failed rows with their prediction and gold record, by row_idx; the failures are the small side and decide what is read on."""
    return failures.join(pred, "row_idx").join(gold, "row_idx")


def in_original_order(rows: DataFrame) -> DataFrame:
    """SRT7."""
    return rows.orderBy("row_idx")
